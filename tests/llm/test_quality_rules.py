import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    held = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


TEXTS = [
    None, "", "   \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\nx\n\nx\n y \n y ", "é ü x y \x0b z \x1c", "# * $ % & | < > <#>",
    "one two three four one two three five two three four", "w " * 5000, "<<>> a\na\nA", "🙂 🙂 🙂 🙂",
]


def docs(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"])[i % len(sources or ["s"])]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_measures(spark):
    got = {r["doc_id"]: r for r in q.score_documents(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t
        assert r["base_failed"] == (brute(t)[0] < 50 or 100 * brute(t)[4] > 50 * brute(t)[0])


@pytest.mark.parametrize("place", [24, 3, 58])
def test_repeats_with_few_bits(spark, place, monkeypatch):
    """With few bits for hashes they collide, with few for places the texts are too long: both sort by words."""
    monkeypatch.setattr(q, "PLACE", place)
    rng = random.Random(place)
    texts = [" ".join(rng.choice("ab") + rng.choice("cdefg" * (i % 3) or "c") for _ in range(rng.randrange(60))) for i in range(120)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in q.score_documents(docs(spark, texts)).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_hosts_condemn_only_what_fails(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}###" for i in range(60))
    rows = [(i, junk if i % 10 else clean, "bad") for i in range(200)] + [(1000 + i, clean if i % 10 else junk, "good") for i in range(200)]
    got = {r["doc_id"]: r["kept"] for r in q.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (i % 10 == 0) for i in range(200))
    assert all(got[1000 + i] for i in range(200))


def test_priors_shrink(spark):
    hosts = spark.createDataFrame([("a", 1, 1), ("b", 1000, 100), ("c", 1000, 120), ("d", 1000, 80)], "_host string, docs long, bad long")
    hosts = hosts.withColumns({f"bad_{r}": F.col("bad") for r in q.RULES})
    p = q.fit_priors(hosts)["short"]
    assert 0 < (1 + p.alpha) / (1 + p.alpha + p.beta) < 1


def test_keep_good_keeps_columns_and_rows(spark):
    base = docs(spark, [" ".join(f"w{i}" for i in range(80)), "short", None], ["x", None])
    odd = base.withColumns({"n_words": F.lit("own"), "_row": F.lit(1), "kept": F.lit(False), "_source": F.lit("z")})
    out = q.keep_good(odd.union(odd))
    assert out.columns == odd.columns and [r["doc_id"] for r in out.collect()] == [0, 0]
    assert out.head()["n_words"] == "own"


@pytest.mark.parametrize("f", [q.score_documents, q.keep_good])
def test_empty(spark, f):
    assert f(docs(spark, ["x"]).where("false")).count() == 0


def test_verdicts_decide_on_the_tables(spark):
    """Hosts well above the prior lose documents that pass the base rules, and only such as fail a rule."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = q.score_documents(table).collect()
    decided = [r for r in rows if r["kept"] != (not r["base_failed"])]
    assert 0 < len(decided) < len(rows) // 10
    assert all(not r["kept"] and any(r[f"fails_{x}"] for x in q.RULES) for r in decided)


def test_equal_hosts_are_not_condemned(spark):
    junk = " ".join(f"word{i}###" for i in range(60))
    rows = [(i, junk if i % 5 == 0 else " ".join(f"word{i}" for i in range(60)), f"h{i // 50}" if i < 200 else None) for i in range(250)]
    assert all(r["kept"] for r in q.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_repeated_ids_and_a_long_text(spark):
    words = [f"w{i}" for i in range(40_000)]
    text = " ".join(words + words[:1000])
    got = q.score_documents(docs(spark, [text, text]).withColumn("doc_id", F.lit(7))).collect()
    assert len(got) == 2 and all((r["doc_id"], r["n_words"], r["n_repeat_words"]) == (7, 41_000, 2000) for r in got)
