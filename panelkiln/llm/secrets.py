r"""Secret scans by a trigram inverted index, in DataFrame and SQL functions only.

From each rule's regex a Boolean trigram query is derived on the driver: the
regex is a sequence, runs of it that can stand for a few strings only become an
OR over those strings of the AND of their trigrams, and the runs are ANDed.

The index holds all trigrams of the lower-cased texts, so it answers rules that
were not known when it was built. Documents and postings (block, trigram, number)
are two tables, bucketed by block: each task that reads documents is a block and
writes it to one bucket, so nothing is shuffled, neither when the index is built
nor when it is asked. A rule's candidates are the documents of the intersection
of its postings; they meet their texts bucket by bucket and are verified there
with the regex itself. A rule whose regex has no mandatory trigram scans all texts.

Null texts are empty and have no spans. Ids may repeat or be null, columns may
have any name: documents are told apart by their place. Long texts are indexed in
pieces, and matches are summed up in pieces, so time and memory stay linear.
Letters of a rule match in either case in ASCII alone, in every engine.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import block_labels, bucketed, free, partitions, setting, text_of, written

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans; pattern: read alike by Java, Python and RE2; group and least: characters that the group must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either(word: str) -> str:
    """A pattern's letters in either case. Classes, as engines differ on what a flag folds (U+017F, U+212A)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed by the contract, in the order of kinds.
BASE = (
    Rule("assign", f"({either('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Published formats of further secrets.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
)
RULES = BASE + EXTRA
#: Of a key without an END line: lines of 16 base64 characters or more, and a shorter one that ends them.
_RUN = r"(?:(?:[\s\\n]*[A-Za-z0-9+/=]{16,})++(?:[\s\\n]*[A-Za-z0-9+/=]+(?=\s*?(?:\n|$)))?)?"
#: For masking a private key goes up to its END line, whatever is reported as its span; header lines and escaped line ends may be in it.
MASKED = tuple(Rule("pem", rf"{r.pattern}(?:[A-Za-z0-9+/=\s:,\\-]*?-----END [A-Z ]*PRIVATE KEY-----|{_RUN})") if r.kind == "pem" else r for r in RULES)

#: Strings that one run of a regex may stand for before it is cut.
MOST = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of sets of trigrams that must all occur, lower-cased; empty if nothing is mandatory."""
    query: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        alternatives = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
        if alternatives and all(alternatives):
            # An alternative that asks for more than another adds nothing.
            query.append([a for a in dict.fromkeys(alternatives) if not any(b < a for b in alternatives)])

    def exact(tokens) -> set[str] | None:
        """All strings of the sequence, lower-cased, or None if they are too many."""
        out = {""}
        for op, arg in tokens:
            more = one(op, arg)
            if more is None or len(out) * len(more) > MOST:
                return None
            out = {a + b for a in out for b in more}
        return out

    def one(op, arg) -> set[str] | None:
        if op is _c.LITERAL:
            return {chr(arg).lower()}
        if op is _c.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is _c.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is _c.RANGE and value[1] - value[0] < MOST:
                    chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is _c.SUBPATTERN:
            return exact(arg[3])
        if op is _c.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if any(x is None for x in parts) else set().union(*parts)
        if op is _c.MAX_REPEAT and arg[1] <= 2:
            base = exact(arg[2])
            if base is None:
                return None
            return set().union(*({""} if n == 0 else {a * n for a in base} for n in range(arg[0], arg[1] + 1)))
        return None

    def walk(tokens) -> None:
        run = {""}
        for op, arg in tokens:
            strings = one(op, arg)
            if strings is not None and len(run) * len(strings) <= MOST:
                run = {a + b for a in run for b in strings}
                continue
            flush(run)
            run = strings if strings is not None else {""}
            if strings is None and op is _c.SUBPATTERN:
                walk(arg[3])
            elif strings is None and op is _c.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(_p.parse(pattern))
    return query


def asked_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for part in trigram_query(r.pattern) for a in part for g in a})


#: Characters of a text that are indexed at once, and matches that are summed up at once.
PIECE, CHUNK = 1 << 16, 256
SPANS = "array<struct<start:long,ord:int,kind:string,end:long>>"


class TrigramIndex:
    """Postings of all trigrams, block by block, beside the documents. An index that is asked once needs only the
    postings that its ``rules`` ask for; it then answers no others."""

    def __init__(self, docs: DataFrame, rules: tuple[Rule, ...] | None = None):
        self.spark, self.columns = docs.sparkSession, docs.columns
        self.block, self.number = free("_block", docs), free("_number", docs)
        n, name = partitions(self.spark), uuid.uuid4().hex
        labels = F.array(*map(F.lit, block_labels(self.spark, n)))
        of_task = F.element_at(labels, F.pmod(F.spark_partition_id(), F.lit(n)) + 1)
        placed = docs.withColumn(self.number, F.monotonically_increasing_id()).withColumn(self.block, of_task)
        self.texts = bucketed(placed, f"scan_texts_{name}", n, self.block)
        low = self.texts.select(F.col(self.block).alias("block"), F.col(self.number).alias("number"), F.lower(text_of()).alias("low"))
        pieces = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("low") / PIECE).cast("int")), lambda i: F.substring("low", i * PIECE + 1, F.lit(PIECE + 2)))
        grams = F.array_distinct(F.regexp_extract_all("piece", F.lit("(?s)(?=(...))"), F.lit(1)))
        if rules is not None:
            asked = asked_trigrams(rules)
            grams = F.array_intersect(grams, F.array(*map(F.lit, asked))) if asked else F.array().cast("array<string>")
        found = low.select("block", "number", F.explode(pieces).alias("piece")).select("block", F.explode(grams).alias("trigram"), "number")
        self.postings = bucketed(found, f"scan_postings_{name}", n, "block", "trigram")

    def candidates(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(block, number, kinds): the rules whose trigram query the postings of a document meet."""
        asked = {r.kind: trigram_query(r.pattern) for r in rules}
        held = self.postings.where(F.col("trigram").isin(asked_trigrams(rules))).groupBy("block", "number").agg(F.collect_set("trigram").alias("held"))

        def met(query: list[list[frozenset[str]]]) -> Column:
            every = F.lit(True)
            for part in query:
                any_of = F.lit(False)
                for a in part:
                    any_of |= F.size(F.array_except(F.array(*map(F.lit, sorted(a))), "held")) == 0
                every &= any_of
            return every

        kinds = F.array_compact(F.array(*[F.when(met(query), F.lit(kind)) for kind, query in asked.items() if query]))
        return held.select("block", "number", kinds.alias("kinds")).where(F.size("kinds") > 0)

    def scan(self, rules: tuple[Rule, ...], spans: str) -> DataFrame:
        """The documents with a column ``spans``: array of (start, ord, kind, end) by start and kind.

        Plan it under ``in_place``, so that blocks meet without a shuffle.
        """
        kinds = free("_kinds", self.texts)
        if not any(trigram_query(r.pattern) for r in rules):
            both = self.texts.withColumn(kinds, F.array().cast("array<string>"))
        else:
            found = self.candidates(rules).select(F.col("block").alias(self.block), F.col("number").alias(self.number), F.col("kinds").alias(kinds))
            both = self.texts.join(found.hint("merge"), [self.block, self.number], "left")
        text, empty = text_of(), F.array().cast(SPANS)
        parts = []
        for i, rule in enumerate(rules):
            found = rule_spans(rule, i, text)
            parts.append(F.when(F.array_contains(kinds, rule.kind), found).otherwise(empty) if trigram_query(rule.pattern) else found)
        return both.withColumn(spans, F.array_sort(F.concat(*parts))).select(*self.columns, spans)

    def in_place(self):
        """Lets a join on block and number use the bucketing by block."""
        return setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def chunked(items: Column) -> Column:
    """The array in arrays of CHUNK; one empty array for none."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))


def running(chunks: Column, grow) -> Column:
    """For each chunk the number that ``grow(number, item)`` has reached before it, from 0."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, c: F.struct(F.aggregate(c, acc["at"], grow).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(chunks, start, step)["out"]


def rule_spans(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, kind, end) of the leftmost non-overlapping matches that are long enough.

    Between the matches lie the pieces of split(); running sums of both lengths give code-point offsets.
    """
    pattern = rule.pattern
    if not rule.group and rule.least and (m := re.fullmatch(r"(.*)(\[[^\]]+\])\+", pattern)) and re.fullmatch(r"[A-Za-z_]*", m[1]):
        # A shorter match is dropped and nothing in it can match anew, so the count can stand in the regex.
        pattern = f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}"
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(rule.group))
    items = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        grown = F.when(F.char_length(x["v"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    chunks, empty = chunked(items), F.array().cast(SPANS)
    starts = running(chunks, lambda at, x: at + F.char_length(x["gap"]) + F.char_length(x["m"]))
    of_chunk = lambda z: F.aggregate(z["items"], F.struct(z["starts"].alias("at"), empty.alias("out")), step)["out"]
    spans = F.flatten(F.transform(F.arrays_zip(chunks.alias("items"), starts.alias("starts")), of_chunk))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, spans: str | None = None) -> DataFrame:
    """All columns of the documents and ``spans`` (secret_spans, with underscores before it if there is such a column):
    array of (start, ord, kind, end) by start and kind. The index serves these rules alone."""
    index = TrigramIndex(docs, rules)
    with index.in_place():
        return written(index.scan(rules, spans or free("secret_spans", docs)), "secret-spans")


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    index = TrigramIndex(docs.select("doc_id", "text"))
    out = index.scan(RULES, "secret_spans")
    kinds = [r.kind for r in BASE]
    base = F.filter("secret_spans", lambda s: s["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    with index.in_place():
        return written(out.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans")), "secret-report")


def masked_text(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <kind>, in chunks of spans, each over its own piece of the text."""
    chunks = chunked(spans)
    starts = running(chunks, lambda at, s: F.greatest(at, s["end"]))

    def of_chunk(z: Column) -> Column:
        base = z["starts"]
        last = F.aggregate(z["items"], base, lambda at, s: F.greatest(at, s["end"]))
        piece = F.substring(text, (base + 1).cast("int"), (last - base).cast("int"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(acc["piece"], (acc["at"] - base + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
            return F.struct(acc["piece"].alias("piece"), F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["done"], gap, mark).alias("done"))

        return F.aggregate(z["items"], F.struct(piece.alias("piece"), base.alias("at"), F.lit("").alias("done")), step)["done"]

    done = F.array_join(F.transform(F.arrays_zip(chunks.alias("items"), starts.alias("starts")), of_chunk), "")
    end = F.aggregate(spans, F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["end"]))
    return F.concat(done, F.substring(text, (end + 1).cast("int"), F.char_length(text)))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with each secret in the text replaced by <kind>; n_chars follows the text, other columns stay.

    Where spans overlap, the one that starts first is replaced and what it covers goes with it.
    """
    spans = free("secret_spans", docs)
    out = find_secrets(docs, MASKED, spans)
    some = F.size(spans) > 0
    out = out.withColumn("text", F.when(some, masked_text(text_of(), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _oracle() -> str:
    """DuckDB SQL of secret_report: matches and the pieces between them, their lengths summed."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        long = f"regexp_extract_all(text, '{p}', {r.group})"
        parts.append(f"""
  SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest({long}) AS v,
         unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS gap,
         generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS nth
  FROM d""")
    union = "\n  UNION ALL".join(parts)
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({union}),
p AS (
  SELECT doc_id, ord, kind, length(v) AS vl, length(m) AS ml,
         sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, ord ORDER BY nth) AS e
  FROM m),
s AS (
  SELECT doc_id, ord, kind, (e - ml)::BIGINT AS s, e::BIGINT AS e FROM p
  WHERE vl >= CASE kind {least} END),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()

