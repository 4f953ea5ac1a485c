"""Quality rules at host level, on DataFrame functions only.

Every document is measured against a few rules. The failures of each rule are counted by
domain (the ``source`` column), each domain's failure rate is shrunk towards the corpus with
a beta prior fitted to all domains, and a domain whose shrunk rate is far above what the prior
expects of a domain has that rule enforced on its documents. The base rules hold for every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import SPACE, WORD, let, materialize, words_of

#: Rules in the order of their columns. The first two are the base rules.
RULES = ("short", "repetitive", "symbols", "dup_lines", "word_length")
#: A rule is enforced in a domain whose shrunk failure rate is above the prior's mean by so many of the
#: prior's standard deviations, and in any case above CONDEMN.
SPREAD, CONDEMN = 0.5, 0.5
#: Prior strength is kept in these bounds where domains differ hardly or extremely.
STRENGTH = (1.0, 1000.0)


@dataclass(frozen=True)
class Prior:
    alpha: float
    beta: float

    @property
    def limit(self) -> float:
        """The shrunk rate above which a host is condemned."""
        strength = self.alpha + self.beta
        mean = self.alpha / strength
        return min(CONDEMN, mean + SPREAD * math.sqrt(mean * (1 - mean) / (strength + 1)))


#: Bits of a packed window that hold its position; the others hold the highest bits of its hash.
PLACE = 24


def _covered(places: Column, width: int) -> Column:
    """Words in the windows at sorted places, each counted once."""
    return F.aggregate(
        places,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _equal_neighbours(s: Column, same) -> Column:
    """The pairs of places of neighbours in a sorted array that ``same`` gives; null ones are left out."""
    return F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), same), lambda x: x.isNotNull())


def _places(pairs: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _repeat_words(words: Column, width: int = 3) -> Column:
    """Number of words in windows of ``width`` words that occur twice or more in the text.

    Windows are sorted as single numbers, hash bits before place. Neighbours of equal hash bits
    are compared word by word; if all are equal, runs of equal bits are runs of equal windows. If
    not, or if the places need more bits, the windows are sorted with their words instead.
    """
    n = F.size(words)
    names = [str(i) for i in range(width)]
    zipped = F.arrays_zip(*[F.slice(words, i + 1, n - (width - 1)) for i in range(width)])
    low = F.lit((1 << PLACE) - 1)

    def by_words(z: Column) -> Column:
        keyed = F.transform(z, lambda x, i: F.struct(F.xxhash64(*[x[k] for k in names]).alias("h"), x.alias("w"), i.alias("p")))
        pairs = let(F.sort_array(keyed), lambda s: _equal_neighbours(s, lambda a, b: F.when((a["h"] == b["h"]) & (a["w"] == b["w"]), F.array(a["p"], b["p"]))))
        return _covered(_places(pairs), width)

    def run(z: Column) -> Column:
        packed = F.transform(z, lambda x, i: F.xxhash64(*[x[k] for k in names]).bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("long")))
        pairs = let(
            F.sort_array(packed),
            lambda s: _equal_neighbours(
                s, lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), PLACE) == 0, F.array(a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")))
            ),
        )
        alike = lambda p: F.get(z, p[0]) == F.get(z, p[1])
        return let(pairs, lambda p: F.when(F.size(p) == 0, 0).when(F.forall(p, lambda x: alike(x)), _covered(_places(p), width)).otherwise(by_words(z)))

    return F.when(n < width, 0).when(n < (1 << PLACE), let(zipped, lambda z: run(z))).otherwise(let(zipped, lambda z: by_words(z)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base measures and one boolean per rule (``fails_<rule>``), and ``base_failed``.

    A null text has no words, lines or symbols; columns of ``docs`` of the same names as the
    added ones are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns(
        {
            "_w": let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))),
            "_l": let(
                F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
                lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")),
            ),
            "word_chars": (F.length(t) - F.length(F.regexp_replace(t, f"{WORD}+", ""))).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        }
    )
    out = counted.withColumns(
        {"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.r"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.d")}
    ).drop("_w", "_l")
    n, chars = F.col("n_words"), F.col("word_chars")
    out = out.withColumns(
        {
            "fails_short": n < 50,
            "fails_repetitive": 100 * F.col("n_repeat_words") > 50 * n,
            "fails_symbols": 10 * F.col("n_symbols") > n,
            "fails_dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
            "fails_word_length": (chars < 2 * n) | (chars > 15 * n),
        }
    )
    return out.withColumn("base_failed", F.col("fails_short") | F.col("fails_repetitive"))


def fit_priors(hosts: DataFrame) -> dict[str, Prior]:
    """A beta prior per rule, by moments of the failure rates of all hosts (one row reaches the driver)."""
    aggs = []
    for r in RULES:
        rate = F.col(f"bad_{r}") / F.col("docs")
        aggs += [F.avg(rate).alias(f"m_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    row = hosts.agg(*aggs).head()
    priors = {}
    for r in RULES:
        mean, var = row[f"m_{r}"], row[f"v_{r}"]
        mean = 0.5 if mean is None else min(max(mean, 1e-6), 1 - 1e-6)
        strength = mean * (1 - mean) / var - 1 if var else STRENGTH[1]
        strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
        priors[r] = Prior(mean * strength, (1 - mean) * strength)
    return priors


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: its shrunk failure rates and, per rule, whether it is enforced there. A null host
    is a host; of one host alone, or of hosts that do not differ, none is condemned below CONDEMN."""
    counts = materialize(
        measured.groupBy(F.col(host).alias("_host")).agg(
            F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"bad_{r}") for r in RULES]
        ),
        "hosts",
    )
    priors = fit_priors(counts)
    return counts.withColumns(
        {f"rate_{r}": (F.col(f"bad_{r}") + p.alpha) / (F.col("docs") + p.alpha + p.beta) for r, p in priors.items()}
    ).withColumns({f"host_{r}": F.col(f"rate_{r}") > p.limit for r, p in priors.items()})


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Join the host verdicts back: ``kept`` is false for a document that fails a base rule, or
    that fails a rule which is enforced in its host. A document that fails no rule stays."""
    small = verdicts.select("_host", F.struct(*[F.col(f"host_{r}").alias(r) for r in RULES]).alias("_v"))
    joined = measured.join(small, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    broken = F.lit(False)
    for r in RULES:
        broken = broken | (F.coalesce(F.col(f"_v.{r}"), F.lit(False)) & F.col(f"fails_{r}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~broken).drop("_v")


def score_documents(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """The measures and verdict of every row of ``docs``; texts are read once.

    A null text counts as empty and fails the base rules; rows that repeat a key are judged each, and
    equal rows alike; an empty table gives an empty one. Other columns of ``docs`` are left out.

    The measures are a few numbers a document, written to the shared folder, since the host
    counts and the final join both read them.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))
    measured = materialize(measure(base).drop("text"), "measures")
    return judge(measured, host_verdicts(measured))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Texts are measured twice, once for the host counts and once to judge, so that no text is
    ever shuffled: the host table is tiny beside the corpus. An empty table stays empty.
    """
    verdicts = materialize(host_verdicts(measure(docs.select(host, text), text), host), "verdicts")
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{host}`").alias("_source"))
    judged = judge(measure(whole, "_text"), verdicts, "_source")
    return judged.where("kept").select("_row.*")
