"""Blocks of postings, the best documents by bounds, the three readers and single files."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lexispark.functions.text import Analyzer
from lexispark.operators import blocks, index, ranking, reports, scoring
from lexispark.sources import collection, sinks


def indexed(spark, n=600):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(d * 3, "every " + " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 25)))) for d in range(n)]
    return index.build(spark.createDataFrame(rows, "docid long, body string"), Analyzer(stop=()), ("body",)).field("body")


def test_blocks_hold_all_postings(spark):
    idx = indexed(spark)
    found = blocks.build(idx, bits=5).cache()
    # A term in every document is many rows, none longer than a block.
    assert found.filter("term = 'every'").count() == 1800 // 32 + 1 and found.agg(F.max("n")).first()[0] <= 32
    assert all(r.places == sorted(r.places) and r.bound == max(r.weights) and r.first == (r.block << 5) + r.places[0] and r.last == (r.block << 5) + r.places[-1] for r in found.collect())
    back = {(r.term, r.docid) for r in blocks.documents(found, bits=5).collect()}
    assert back == {(r.term, r.docid) for r in idx.tf.collect()}
    with pytest.raises(ValueError):
        blocks.build(idx, bits=16)


def test_the_best_by_bounds_are_the_best(spark):
    idx = indexed(spark)
    topics = spark.createDataFrame([(1, "w39 w0"), (2, "every w1"), (3, "w38 w30 every"), (4, "nowhere"), (5, "w2")], "qid long, query string")
    found, skipped = blocks.top(idx, blocks.build(idx, bits=4).cache(), topics, 5, 4)
    want = ranking.rank(scoring.score(idx, topics), 5)
    rows = lambda df: sorted((r.qid, r["rank"], r.docid, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(want)
    counts = {r.qid: (r.blocks, r.skipped) for r in skipped.collect()}
    assert set(counts) == {1, 2, 3, 5} and counts[3][1] > 0 and all(s < n for n, s in counts.values())


QUIRKS = ".I 1\n.T\nfirst title\n.T own text\nmore title\n.A\nan author\n.A beside\n.B\n paper\n.W on the line\nbody one\n.T stray title\n.A\nstray author\n.B here\nbody two\n.W again\nend\n.I 2\nbefore any tag\n.Wedge words\nlast\n.I 3\n .W\nindented\n.W\n"


def walked(text, form):
    """The three forms by plain loops."""
    out = {}
    for record in re.split(r"(?m)^\.I ", text)[1:]:
        head, *lines = record.split("\n")
        fields, now, begun = {k: [] for k in collection.TAGS.values()}, None, False
        for line in lines:
            if form == "strict":
                m = re.match(r"\.([TABW])(.*)$", line)
                if m and not (now == "body" and m[1] in "TAB"):
                    now = collection.TAGS["." + m[1]]
                    continue
                line = m[2] if m else line
            elif form == "merged":
                m = re.match(r"\.([TABW])\s*$", line)
                if m and not (begun and m[1] in "AB"):
                    now, begun = collection.TAGS["." + m[1]], begun or m[1] == "W"
                    continue
                line = "" if m else line
            else:
                m = re.match(r"\.([TABW])( .*)?$", line.strip())
                if m and not (begun and m[1] in "AB"):
                    now, begun = collection.TAGS["." + m[1]], begun or m[1] == "W"
                line = (m[2] or "") if m else line
            if now and line.strip():
                fields[now].append(line.strip())
        out[int(head)] = {k: " ".join(v) for k, v in fields.items()}
    return out


@pytest.mark.parametrize("form", ["merged", "strict", "fielded"])
def test_three_readers_of_one_file(spark, tmp_path, form):
    (tmp_path / "c").write_text(QUIRKS)
    got = {r.docid: r.asDict() for r in collection.read_collection(spark, str(tmp_path / "c"), form=form).collect()}
    want = walked(QUIRKS, form)
    assert {d: {k: r[k] for k in collection.TAGS.values()} for d, r in got.items()} == want
    assert ("stray title" in want[1]["body"]) == (form == "strict")


def test_a_run_is_one_file_and_a_failed_one_leaves_the_old(spark, tmp_path):
    path = str(tmp_path / "run")
    lines = spark.range(500).selectExpr("id % 7 AS qid", "id AS rank", "concat(id % 7, ' ', id) AS line").repartition(6)
    sinks.write_run(lines, path, single=True)
    want = "".join(f"{q} {r}\n" for q, r in sorted((i % 7, i) for i in range(500)))
    assert os.path.isfile(path) and open(path).read() == want
    bad = lines.withColumn("line", F.when(F.col("rank") == 300, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_run(bad, path, single=True)
    assert open(path).read() == want and [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["run"]
    sinks.write_run(lines.filter("qid = 1"), path, single=True)
    assert open(path).read().startswith("1 1\n1 8\n")


def test_digests_of_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x long, y string")
    one = lambda df: tuple(reports.table_digest(df).first())
    assert one(t) == one(t.repartition(3).select("y", "x")) and one(t)[0] == 3
    assert len({one(t), one(t.distinct()), one(t.fillna("")), one(t.filter("false"))}) == 4
