"""Secret scans with an inverted trigram index, on DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived. One pass over every text finds which
of the trigrams that the queries name it holds; these postings are turned into lists of texts by
trigram, in segments of bounded size, and the lists are intersected by each rule's query. Texts
that remain are joined with the rules they are candidates of and verified with the patterns
themselves. Rules without mandatory trigrams scan every text.

The index is over distinct texts, by their hashes: equal texts have equal postings, and unequal
ones of an equal hash share theirs, which makes candidates but loses none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import let, materialize
from strata.llm.trigrams import query


@dataclass(frozen=True)
class Rule:
    """least: code points that ``group`` of a match must have, or the match is dropped; its span is the whole match.
    mask and by: what ``redact`` replaces, and by what before the mark; by default the pattern."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    hint: str | None = None  # for rules that scan fully: a cheaper pattern that any kept match holds
    mask: str | None = None
    by: str = ""


#: The base rules come first, in their order for ties.
RULES = (
    Rule(
        "assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2,
        mask=r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{12,}""", by="$1",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, mask=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 16, hint=r"[0-9a-f]{16}", mask=r"[0-9a-f]{16,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", r"gh[oprsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}"),
)
BASE = 3
#: Postings in a segment of the index, about: the lists of a segment are intersected within one row.
SEGMENT = 1 << 14
#: Bits of the broadcast bitmap of candidates' hashes, 1 MiB however many there are, and bits in one of its rows.
BITS, ROW = 1 << 23, 1 << 15
#: Rows of a text that very many documents share are spread over so many keys before they meet its candidate.
SALTS = 16


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries name, in a fixed order."""
    return sorted({t for r in rules for clause in query(r.pattern) or () for t in clause})


def _any_of(trigrams: list[str]) -> str:
    """A pattern that matches, without taking it, any of the trigrams; the first group is the trigram."""
    quoted = lambda c: "\\" + c if not c.isalnum() else c
    tree: dict[str, dict[str, set[str]]] = {}
    for a, b, c in trigrams:
        tree.setdefault(a, {}).setdefault(b, set()).add(c)
    one = lambda of: "[" + "".join(map(quoted, sorted(of))) + "]"
    arms = [quoted(a) + "(?:" + "|".join(quoted(b) + one(c) for b, c in sorted(second.items())) + ")" for a, second in sorted(tree.items())]
    return f"(?={one(tree)})(?=({'|'.join(arms)}))"


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(id, t)`` -> ``(trigram, id)``: which of the trigrams each text holds, in either case; one pass over the text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_any_of(trigrams)), F.lit(1)))
    return texts.select(F.explode(found).alias("trigram"), "id")


def index(posted: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Postings -> ``(segment, trigram, ids)``: the inverted lists. Segments are dealt by the texts' hashes, so that
    no list grows beyond about ``segment`` ids however common its trigram is."""
    segments = max(1, -(-posted.count() // segment))
    return posted.groupBy(F.pmod("id", F.lit(segments)).alias("segment"), "trigram").agg(F.collect_set("id").alias("ids"))


def search(lists: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, rules)``: the texts that the intersected lists leave, and of which rules they are candidates, as bits.
    Rules without mandatory trigrams are not among them."""
    none = F.array().cast("array<bigint>")
    held = lists.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("of"))
    found = []
    for i, r in enumerate(rules):
        clauses = query(r.pattern)
        if clauses is None:
            continue
        for clause in sorted(clauses, key=sorted):
            each = [F.coalesce(F.try_element_at("of", F.lit(g)), none) for g in sorted(clause)]
            bit = F.lit(1 << i).alias("bit")
            found.append(F.transform(reduce(F.array_intersect, each), lambda x: F.struct(x.alias("id"), bit)))  # noqa: B023
    pairs = held.select(F.explode(F.flatten(F.array(*found))).alias("_p"))
    return pairs.groupBy("_p.id").agg(F.bit_or("_p.bit").alias("rules"))


def _bitmap(ids: DataFrame) -> DataFrame:
    """``(row, bits)``: a bitmap over the ids modulo BITS, BITS / ROW rows of ROW / 8 bytes at most."""
    at = F.pmod("id", F.lit(BITS))
    return ids.groupBy(F.floor(at / ROW).cast("int").alias("_map_row")).agg(F.bitmap_construct_agg(at % ROW).alias("_map_bits"))


def _with_candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(_row, _t)`` -> the same with ``_rules``, the bits of the rules that the index leaves.

    Only texts whose bit in the bitmap of candidates is set are joined with the candidates and thus
    shuffled; the bitmap is broadcast, as its size is bounded. Where candidates fill it, all are joined.
    """
    trigrams = vocabulary(rules)
    rows = rows.withColumn("_id", F.xxhash64("_t"))
    if not trigrams:
        return rows.withColumn("_rules", F.lit(0))
    posted = materialize(postings(rows.select(F.col("_id").alias("id"), F.col("_t").alias("t")), trigrams).distinct(), "postings")
    found = materialize(search(index(posted), rules), "candidates")
    at = F.pmod("_id", F.lit(BITS))
    byte = F.conv(F.hex(F.substring("_map_bits", F.shiftright((at % ROW).cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    told = rows.join(F.broadcast(materialize(_bitmap(found), "bitmap")), F.floor(at / ROW).cast("int") == F.col("_map_row"), "left").withColumn("_maybe", set_)
    told = told.drop("_map_row", "_map_bits")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = found.select(F.col("id").alias("_id"), F.col("rules").alias("_rules"), salts.alias("_salt")).hint("merge")
    near = told.where("_maybe").withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    met = near.join(asked, ["_id", "_salt"], "left").withColumn("_rules", F.coalesce("_rules", F.lit(0)))
    return told.where("not _maybe").select("_row", "_t", F.lit(0).alias("_rules")).union(met.select("_row", "_t", "_rules"))


#: Numbers that are added up in one go; longer arrays are added up by parts of this length and then across them.
PART = 256


def _running(numbers: Column) -> Column:
    """The running totals of an array of ints. Growing an array copies it, so it is done within parts."""
    none = F.array().cast("array<int>")

    def within(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("sum"), none.alias("sums")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums")),
            lambda acc: acc["sums"],
        )

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / PART).cast("int")), lambda i: within(F.slice(numbers, i * PART + 1, F.lit(PART))))
    whole = let(parts, lambda p: let(within(F.transform(p, lambda x: F.element_at(x, -1))), lambda ends: F.transform(p, lambda x, i: F.transform(x, lambda y: y + F.coalesce(F.get(ends, i - 1), F.lit(0))))))
    return F.when(F.size(numbers) > 0, F.flatten(whole)).otherwise(none)


SPANS = "array<struct<start:int,n:int,stop:int,kind:string>>"


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """The kept matches of a text as structs (start, n, stop, kind), in code points.

    ``split`` gives the gaps between the matches of the same pattern, and so the positions.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern if rule.group else f"({rule.pattern})"), F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else whole
    found = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")), lambda x: x["whole"].isNotNull())

    def placed(found: Column) -> Column:
        stops = _running(F.transform(found, lambda x: x["gap"] + x["whole"]))
        each = F.filter(F.arrays_zip(found.alias("m"), stops.alias("stop")), lambda x: x["m"]["part"] >= rule.least)
        return F.transform(each, lambda x: F.struct((x["stop"] - x["m"]["whole"]).alias("start"), F.lit(number).alias("n"), x["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))

    return let(found, placed)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``into``, the array of all spans sorted by start and then by the rules' order.

    Null and empty texts have no spans. Spans of different rules may overlap; those of one
    rule do not. A column named ``into`` is replaced. Repeated rows come back as often as they
    occur, an empty table stays empty, and texts of any length and number of findings are whole.
    """
    names = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    found = []
    for i, r in enumerate(rules):
        wanted = F.col("_rules").bitwiseAND(F.lit(1 << i)) != 0 if query(r.pattern) is not None else F.col("_t").rlike(r.hint or r.pattern)
        found.append(F.when(wanted, _spans(F.col("_t"), r, i)).otherwise(F.array().cast(SPANS)))
    return _with_candidates(rows, rules).select("_row.*", F.sort_array(F.concat(*found)).alias(into))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["n"] == number))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans of every row. Null and empty
    texts have no spans; rows that repeat a key are reported each; an empty table gives an empty one."""
    found = find_secrets(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    spans = F.col("secrets")
    counts = [_count(spans, i).cast("long").alias(f"n_{RULES[i].kind}") for i in range(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.filter(spans, lambda x: x["n"] < BASE)), 256).alias("base_sha256"), _joined(spans).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every secret replaced by ``mark``; of an assignment, its value.

    Every row stays, and texts without a finding are untouched. Where a text has findings,
    each rule's pattern is replaced throughout it, which covers all of its spans. ``n_chars``
    follows the new text where there is such a column.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    found = find_secrets(rows, "_text", "_secrets")
    clean = F.col("_text")
    for r in RULES:
        clean = F.regexp_replace(clean, r.mask or r.pattern, r.by + mark)
    # a text without findings, null included, stays as it is
    changed = found.withColumn("_dirty", F.size("_secrets") > 0).withColumn("_clean", F.when(F.col("_dirty"), clean).otherwise(F.col("_text")))
    out = [F.col("_clean").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        out[docs.columns.index("n_chars")] = F.when(F.col("_dirty"), F.length("_clean")).otherwise(F.col("_row.n_chars")).cast("long").alias("n_chars")
    return changed.select(*out)
