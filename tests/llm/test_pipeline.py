"""The pipeline: each stage against what it says of its own input, then the whole run."""

import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import ngram_join
from quarry.llm.common import BATCH_BYTES, BATCH_KEY, durable, labelled_sample, mapped, table

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_and_run(spark):
    assert [name for name, _ in P.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs, seen = table(spark, FOLDER, "documents"), []
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = durable(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        seen.append(docs.collect())
    first = {tuple(r) for r in table(spark, FOLDER, "documents").collect()}
    calm, good, one, mix = seen
    assert {tuple(r) for r in good} <= {tuple(r) for r in calm} <= first and good

    # one document of each class of the good ones stays, and nothing without a partner goes
    label = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(good, docs.schema)).collect()}
    assert sorted(r.doc_id for r in one) == sorted(set(label.values()))
    sets = [shingles(r.text) for r in one]
    assert not any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a, b in combinations(sets, 2))

    taken = Counter(r.doc_id for r in mix)
    assert set(taken) <= {r.doc_id for r in one} and max(taken.values()) <= 3

    packed = P.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == taken
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_a_sample_needs_no_python_workers(spark, monkeypatch):
    """A list of rows would be read by Python workers of the RDD kind, which stay beside those of mapInArrow()."""
    given, create = [], spark.createDataFrame
    docs, labels = create([(k, f"text {k}") for k in range(9)], "doc_id long, text string"), create([(k, k % 2) for k in range(9)], "doc_id long, quality int")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: given.append(create(data, *a, **k)) or given[-1])
    got = labelled_sample(docs, labels, "quality", F.lit(True), 3, 1000)
    assert len(given) == 1 and not any("Python" in line for line in given[0]._jdf.queryExecution().toRdd().toDebugString().split("\n"))
    assert len(got) == 6 and all(int(t.split()[1]) % 2 == k for t, k in got)


def test_batches_of_texts_are_small(spark):
    before = spark.conf.get(BATCH_KEY)
    try:
        spark.conf.unset(BATCH_KEY)
        docs = spark.range(40, numPartitions=1).selectExpr("id", "repeat(chr(97 + id % 26), 1000000) AS text")

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

        got = mapped(docs, sizes, "rows long, size long").collect()
        assert sum(r["rows"] for r in got) == 40 and max(r["size"] for r in got) < 2 * BATCH_BYTES
        spark.conf.set(BATCH_KEY, "1m")
        mapped(docs, sizes, "rows long, size long")
        assert spark.conf.get(BATCH_KEY) == "1m"
    finally:
        spark.conf.set(BATCH_KEY, before)
