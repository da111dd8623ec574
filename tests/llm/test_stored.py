"""Files that stored steps leave behind, and rounds dealt into parts."""

import pytest
from pyspark.sql import functions as F

from panelkit.llm import suffixes
from panelkit.llm.stored import DROP_SHUFFLES, stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = stored(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("g")).count())
    assert not shuffle_files(spark) - before
    assert out.count() == 7
    assert spark.conf.get(DROP_SHUFFLES, "false") == "false"


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_parts_of_the_second_round_agree(spark, monkeypatch, parts):
    monkeypatch.setattr(suffixes, "PARTS", parts, raising=False)
    seen = []
    real = suffixes._windows
    monkeypatch.setattr(suffixes, "_windows", lambda *a: seen.append(1) or real(*a))
    words = " ".join(f"w{i * i % 997}" for i in range(60))
    rows = [(i, f"begin {i} " + words[i:] + f" end {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    earlier, want = set(), {}
    for doc, text in rows:
        gone = set()
        for at in range(len(text) - 99):
            if text[at:at + 100] in earlier:
                gone.update(range(at, at + 100))
            earlier.add(text[at:at + 100])
        want[doc] = len(gone)
    assert {r.doc_id: r.n_removed for r in suffixes.cleaned(docs).collect()} == want
    assert len(seen) == parts
