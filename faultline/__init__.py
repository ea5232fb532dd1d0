"""faultline: Spark-native analytics for telemetry root-cause analysis."""
