"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Only SQL functions.  Places come from the pieces between matches: split() and
regexp_extract_all() see the same matches, so running lengths of both give code-point
offsets.  A text of many matches is no worse than a long one: running sums are taken in
chunks, and the context of a match comes from the ends of the pieces before it.  The
kinds of ``BASE`` are always kept when their check passes; the others are kept from a
score of ``LEAST_SCORE`` on.

Edge cases: a null or empty text has no spans; texts of any length and any number of
matches or repeats inside one are read whole; ties in start are ordered by kind; a
repeated row gives a repeated result; an empty table gives an empty result; columns of
the input pass unchanged and a column named ``spans`` is replaced.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds in order of listing.
BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "national_id", "access_key", "secret")
KINDS = BASE + MORE
#: Patterns (leftmost, not overlapping).  \G or a look-behind lets a run of characters be tried at its start only, which is enough for these shapes and keeps long runs linear; possessive repeats of groups keep the matcher from recursing once for each.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?:token|password|passwd|secret|key)\x20{0,2}[=:]\x20{0,2}[\x22']{0,1})[A-Za-z0-9+/_-]{8,}",
}
#: A text without this needs no look at the pattern.
GUARDS = {"email": "@", "phone": "+", "national_id": "-", "access_key": "AKIA"}
#: Score of a confirmed match, words that raise it, by how much, how far before the match they may stand, and the least score of kinds outside BASE.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "national_id": 0.3, "access_key": 0.9, "secret": 0.7}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile",
    "iban": "iban|account|bank|transfer", "national_id": "ssn|social|security|national|id", "access_key": "aws|access|key", "secret": "token|password|secret|key",
}
RAISE, CONTEXT_CHARS, LEAST_SCORE = 0.2, 40, 0.5
#: Matches before a match that can reach into its context (each has two characters or more), and elements of a chunk of running sums.
REACH, CHUNK = CONTEXT_CHARS // 2, 256


def let(value: Column, body) -> Column:
    """body(value), the value being computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def tail(value: Column) -> Column:
    return F.substring(value, F.greatest(F.lit(1), F.char_length(value) - CONTEXT_CHARS + 1), F.lit(CONTEXT_CHARS))


def sums_before(values: Column) -> Column:
    """For each element of an array of int the sum of those before it: in chunks, since a growing array is copied at each step."""
    none = F.array().cast("array<int>")
    grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    running = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("out")), grow)
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / CHUNK).cast("int")), lambda k: running(F.slice(v, k * CHUNK + 1, CHUNK)))
    raised = lambda c: let(running(c["at"])["out"], lambda bases: F.flatten(F.transform(c["out"], lambda xs, k: let(F.get(bases, k), lambda base: F.transform(xs, lambda x: x + base)))))
    return let(values, lambda v: let(chunks(v), raised))


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array of (s, e, v, ends, gap), in code points; ends: last characters of the piece before the match and of both together."""
    empty = F.array().cast("array<struct<s:int,e:int,v:string,gap:string,ends:string>>")

    def placed(found: Column) -> Column:
        steps = F.transform(F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("v")), lambda x: F.struct(F.char_length(x["gap"]).alias("g"), F.char_length(x["v"]).alias("n"), x["v"].alias("v"), tail(x["gap"]).alias("gap"), tail(F.concat(tail(x["gap"]), tail(x["v"]))).alias("ends")))
        before = lambda st: sums_before(F.transform(st, lambda x: x["g"] + x["n"]))
        row = lambda x: F.struct((x["b"] + x["x"]["g"]).alias("s"), (x["b"] + x["x"]["g"] + x["x"]["n"]).alias("e"), x["x"]["v"].alias("v"), x["x"]["gap"].alias("gap"), x["x"]["ends"].alias("ends"))
        return let(steps, lambda st: F.transform(F.arrays_zip(st.alias("x"), before(st).alias("b")), row))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(placed(found)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of a string of digits."""
    n = F.char_length(number)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """Checksum of an international account number."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(moved)), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    """Whether a match passes its kind's check."""
    value = m["v"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.char_length(digits(value))
        return F.when((n >= 12) & (n <= 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def scored(kind: str, number: int, found: Column) -> Column:
    """The spans of the confirmed matches with their scores."""
    order = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    valid = F.filter(order, lambda x: confirmed(kind, x["m"]))

    def span(x: Column) -> Column:
        m, before = x["m"], F.slice(found, F.greatest(F.lit(1), x["i"] - REACH + 1), F.least(x["i"], F.lit(REACH)))
        context = tail(F.concat(F.array_join(before["ends"], ""), m["gap"]))
        near = F.lower(context).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])")
        score = F.lit(SCORES[kind]) + F.when(near, RAISE).otherwise(0.0)
        return F.struct(m["s"].alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), m["e"].alias("end"), score.alias("score"))

    return F.transform(valid, span)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with spans: array of (start, kind_no, kind, end, score), in order of start and kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    has_digit = body.rlike("[0-9]")
    columns = {}
    for number, kind in enumerate(KINDS):
        guard = F.contains(body, F.lit(GUARDS[kind])) if kind in GUARDS else F.lit(True)
        guard = guard if kind in ("email", "secret") else guard & has_digit
        guard = guard & body.rlike("(?:token|password|passwd|secret|key)\\x20{0,2}[=:]") if kind == "secret" else guard
        spans = let(matches(body, PATTERNS[kind]), partial(scored, kind, number))
        if kind in MORE:
            spans = F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)
        columns[f"_{kind}"] = F.when(guard, spans).otherwise(F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>"))
    found = docs.drop("spans").withColumns(columns)
    return found.withColumn("spans", F.array_sort(F.concat(*columns))).drop(*columns)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs of find() with each span of the text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), more.alias("out")))

    done = F.aggregate("spans", zero, step)
    return docs.withColumn(text, F.when(F.size("spans") == 0, F.col(text)).otherwise(F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.char_length(text)))))
