"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Only SQL expressions, evaluated row by row where the text is read: no shuffle, no Python. The
offsets of a pattern's matches come from the pieces between them: start = lengths of all pieces
and matches before.

Entropy: a candidate is a run of token characters with letters and digits. A window of `WINDOW`
characters slides over it; one count goes up and one down per step, and the sum of c*log2(c) is
adjusted by those two terms alone. The counts of a window lie five bits each in a few integers, so a step
adds to one and subtracts from one. Windows at or over the threshold of the candidate's character
class (hexadecimal, letters and digits, base64) that overlap or touch are one span, unless the candidate is
on the allow-list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Characters of a candidate by number; counts of so many of them lie in one integer.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PACKED = 12
#: Matches whose offsets are added up one after the other; longer lists go by blocks of so many.
BLOCK = 64
#: Character classes in the order tried: pattern of the whole candidate, least bits a character.
CLASSES = (("^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9), ("^[A-Za-z0-9]+$", 3.4), ("^.*$", 3.6))
#: Whole candidates that are no secrets: UUIDs, counting or repeated characters, placeholders, paths of words.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|1234567890|abcdefghij|(.)\1{5}",
    r"(?i)example|placeholder|changeme|dummy|your_?(?:key|token|secret)",
    # possessive, so that no length of candidate is matched by recursion
    r"^(?:[A-Za-z]++|[0-9]{1,4}+)(?:[-_/=](?:[A-Za-z]++|[0-9]{1,4}+))++$",
)


def pattern_spans(text: Column, pattern: str, kind: int, accept) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches that `accept(match, group 2)` passes."""
    groups = 2 if "([A-Za-z0-9+/_.=-]+)" in pattern else 0
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)).alias("value"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["all"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        ok = x["all"].isNotNull() & accept(x["all"], x["value"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def block(parts: Column, low: Column) -> Column:
        return F.aggregate(F.slice(parts, low, BLOCK), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def placed(blocks: Column) -> Column:
        """The spans of all blocks, moved by the lengths of the blocks before."""
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, low: F.transform(b["spans"], lambda s: F.struct(
            (s["start"] + low).alias("start"), s["kind"].alias("kind"), (s["end"] + low).alias("end")))))

    # the list of parts is bound to a name, as an expression it would be evaluated anew for each block
    found = F.flatten(F.transform(F.array(parts), lambda p: placed(F.transform(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), lambda low: block(p, low)))))
    return F.when(text.rlike(pattern), found).otherwise(none)


RANGE = "array<struct<first:int,last:int>>"


def entropy_ranges(value: Column) -> Column:
    """(first, last) of each group of touching windows of a candidate that reach its class's threshold."""
    least = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(value.rlike(pattern), F.lit(bits)).otherwise(least)
    most = (math.log2(WINDOW) - least) * WINDOW  # entropy >= least  <=>  sum of c*log2(c) <= most
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    words = -(-len(ALPHABET) // PACKED)
    weights = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)])

    def count(acc: Column, code: Column) -> Column:
        shift = F.pmod(code, F.lit(PACKED)) * 5
        word = F.lit(0).cast("long")
        for k in range(words):
            word = F.when(F.floor(code / PACKED) == k, acc[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, shift).bitwiseAND(31).cast("int")

    def step(acc: Column, i: Column) -> Column:
        full = i > WINDOW
        new, old = F.element_at(acc["codes"], i), F.element_at(acc["codes"], F.greatest(i - WINDOW, F.lit(1)))
        same = full & (new == old)
        up, down = count(acc, new), count(acc, old)
        weight = lambda n: F.element_at(acc["weights"], n + 1)
        change = weight(up + 1) - weight(up) + F.when(full, weight(F.greatest(down - 1, F.lit(0))) - weight(down)).otherwise(F.lit(0.0))
        total = acc["total"] + F.when(same, F.lit(0.0)).otherwise(change)

        def one(code: Column, k: int) -> Column:
            return F.when(F.floor(code / PACKED) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(PACKED)) * 5)).otherwise(F.lit(0).cast("long"))

        counts = [(acc[f"w{k}"] + one(new, k) - F.when(full, one(old, k)).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(words)]
        high = (i >= WINDOW) & (total <= acc["most"] + 1e-9)
        apart = high & (acc["last"].isNull() | (i - WINDOW > acc["last"]))
        closed = F.when(apart & acc["last"].isNotNull(), F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(acc["done"])
        return F.struct(acc["codes"].alias("codes"), acc["weights"].alias("weights"), acc["most"].alias("most"), total.alias("total"), *counts,
                        F.when(apart, i - WINDOW).otherwise(acc["first"]).alias("first"), F.when(high, i).otherwise(acc["last"]).alias("last"), closed.alias("done"))

    start = F.struct(codes.alias("codes"), weights.alias("weights"), most.alias("most"), F.lit(0.0).alias("total"), *[F.lit(0).cast("long").alias(f"w{k}") for k in range(words)],
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.array().cast(RANGE).alias("done"))
    last = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, step,
                       lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], last(acc))))


def entropy_spans(text: Column) -> Column:
    def wanted(value: Column, _: Column) -> Column:
        # no threshold is reached by seven different characters; only long candidates are worth counting them
        varied = F.when(F.char_length(value) > 4 * WINDOW, F.size(F.array_distinct(F.split(value, ""))) > 7).otherwise(F.lit(True))
        ok = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied
        for pattern in ALLOW:
            ok &= ~value.rlike(pattern)
        return ok

    candidates = pattern_spans(text, CANDIDATE, len(KINDS) - 1, wanted)

    def ranged(s: Column) -> Column:
        return F.transform(entropy_ranges(F.substring(text, s["start"] + 1, s["end"] - s["start"])), lambda r: F.struct(
            (s["start"] + r["first"]).alias("start"), F.lit(len(KINDS) - 1).alias("kind"), (s["start"] + r["last"]).alias("end")))

    return F.flatten(F.transform(candidates, ranged))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of `docs` (doc_id, text).

    Both are arrays of (start, kind, end) in code points, end exclusive, sorted by start, then
    kind as numbered in KINDS; base holds the kinds before entropy. Null texts count as empty and
    have none. Of spans that start together all stay. A very long text is one row of its task, its
    matches added up in blocks. Repeated rows give repeated results; other columns aren't read; an empty table
    gives no rows.
    """
    def length(n: int):
        return lambda match, _: F.char_length(match) >= n

    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sort_array(F.concat(
        pattern_spans(text, ASSIGN, 0, lambda _, value: F.char_length(value) >= 6),
        pattern_spans(text, ACCESS, 1, length(20)),
        # the runs are maximal, so asking for 24 at once finds the runs of 24 or more that `+` finds
        pattern_spans(text, HEX.replace("+", "{24,}"), 2, length(24)))).alias("base"), entropy_spans(text).alias("more"))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", "more")).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The counts, hash and text forms of the spans of `find`."""
    def joined(spans: str) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [of_kind(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digests_sql() -> str:
    """DuckDB SQL for `digests` of `find` over documents: offsets from the pieces between matches, entropy of every window counted anew."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    # this dialect folds more than A-Z and knows no back references or possessive repeats
    assign = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))))
    repeated = "|".join(f"(?:{either(c.lower()) if c.isalpha() else '[' + c + ']'}){{6}}" for c in ALPHABET if not c.isupper())
    allowed = [p.replace("(.)\\1{5}", repeated).replace("++", "+").replace("}+", "}") for p in ALLOW]
    kinds = ((assign, 2, 6), (ACCESS, 0, 20), (HEX, 0, 24), (CANDIDATE, 0, 20))
    found = " UNION ALL ".join(
        f"SELECT doc_id, rid, {k} AS kind, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS alls, regexp_extract_all(t, {quoted(p)}, {g}) AS vals, {n} AS least FROM t"
        for k, (p, g, n) in enumerate(kinds))
    bits = " ".join(f"WHEN regexp_matches(v, {quoted(p)}) THEN {b}" for p, b in CLASSES)
    name = f"({'[' + ', '.join(map(quoted, KINDS)) + ']'})[kind + 1]"
    return f"""WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents), f AS ({found}),
u AS (SELECT doc_id, rid, kind, least, gaps, alls, vals, unnest(range(1, len(alls) + 1)) AS i FROM f),
m AS (SELECT doc_id, rid, kind, alls[i] AS v, vals[i] AS val, least,
 CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(alls[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM u),
base AS (SELECT rid, kind, a, a + length(v) AS b FROM m WHERE kind < 3 AND length(val) >= least),
c AS (SELECT rid, a, v, CASE {bits} END AS least FROM m WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT ({' OR '.join(f'regexp_matches(v, {quoted(p)})' for p in allowed)})),
w AS (SELECT rid, a, least, v, unnest(range(0, length(v) - {WINDOW - 1})) AS i FROM c),
h AS (SELECT rid, a, i FROM w WHERE list_aggregate(string_split(substring(v, CAST(i AS BIGINT) + 1, {WINDOW}), ''), 'entropy') >= least - 1e-9),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid, a ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM h),
n AS (SELECT rid, a, i, sum(fresh) OVER (PARTITION BY rid, a ORDER BY i) AS part FROM g),
spans AS (SELECT rid, kind, a, b FROM base UNION ALL SELECT rid, 3, a + min(i), a + max(i) + {WINDOW} FROM n GROUP BY rid, a, part),
s AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 string_agg(CASE WHEN kind < 3 THEN {name} || ':' || a || ':' || b END, ',' ORDER BY a, kind, b) AS base, string_agg({name} || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (rid)"""
