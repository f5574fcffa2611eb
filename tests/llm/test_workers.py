"""Python workers serve stage after stage; what an operator keeps in them must not add up."""

import pyarrow as pa

from rulespark.llm import decontamination, jaccard_join, packing
from rulespark.llm.common import small_batches


TEXT = " ".join(f"word{k}" for k in range(60))


def test_a_task_clears_what_other_operators_kept(spark, monkeypatch):
    docs, caught = spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f) or spark.createDataFrame([], schema))
    monkeypatch.setattr(decontamination, "stored", lambda df, tag: df)
    packing.pack(docs)
    jaccard_join.measured(docs, 5)
    jaccard_join.block_groups(docs, 5, 80, 1)
    decontamination.build_index(docs, {b"word1": 0})
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    pack, measured, emit, _, index = caught
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([TEXT])], ["doc_id", "text"])
    run = lambda f, columns=("doc_id", "text"): sum(b.num_rows for b in f(iter([batch.select(list(columns))])))
    assert run(pack) == 1 and packing.ENCODERS
    assert run(measured) == 1 and jaccard_join.WORDS and not packing.ENCODERS
    assert run(emit, ["text"]) and jaccard_join.WORDS  # tasks of one operator share what it kept
    assert run(pack) == 1 and packing.ENCODERS and not jaccard_join.WORDS
    assert run(index) == 1 and not packing.ENCODERS


def test_arrow_batches_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        small_batches(spark.range(1))
        assert int(spark.conf.get(name).rstrip("b")) <= 2 << 20
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_special_tokens_load_the_tokenizer_when_needed():
    encoder = packing.Encoder(packing.tokenizer_path())
    plain, = encoder.encode(["one two"])
    assert encoder.tokenizer is None
    special, = encoder.encode([encoder.special[0] + "one two"])
    assert encoder.tokenizer and len(special) == len(plain) + 4 and special.endswith(plain)
