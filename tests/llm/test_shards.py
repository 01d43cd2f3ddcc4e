"""Token shards: ids against the model itself, round trips, and input whose rows move between runs."""

import os
import random

import numpy as np
import pytest

from spanwise.llm import feistel, shards

pytestmark = pytest.mark.skipif(not os.path.exists(shards.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=shards.TOKENIZER)


def odd_texts(n=3000):
    rng = random.Random(17)
    letters = ["a", "b", "the", "1", " ", " ", "  ", "\n", "\t", "▁", "▁▁", "é", "日本", "😀", "\x00", " ", "​", "<s>", "</s>", "<unk>", "<0x0A>", "'", "\r", "é", "ﬁ"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_ids_are_the_models(model):
    texts = odd_texts()
    got = shards.encode(texts, shards.TOKENIZER)
    assert [x.tolist() for x in got] == [[*model.encode(t), model.eos_id()] for t in texts]


def stream(folder, manifest, length, key=1):
    data = b"".join((folder / f"shard-{r.shard:08d}.bin").read_bytes() for r in sorted(manifest, key=lambda r: r.shard))
    slots = np.frombuffer(data, dtype="<u2").reshape(-1, length)
    return slots[feistel.permute(np.arange(len(slots)), len(slots), key)].ravel()[: sum(r.tokens for r in manifest)]


def texts_of(ids, end):
    out, part = [], []
    for t in ids.tolist():
        if t == end:
            out.append(tuple(part))
            part = []
        else:
            part.append(t)
    return out


@pytest.mark.parametrize("length, per_shard", [(16, 8), (2048, 4)])
def test_query_tokenizer_round_trip(spark, tmp_path, model, length, per_shard):
    texts = [*odd_texts(200), None, "", "word " * 60_000, "x" * 100_000, *["same text"] * 40]
    docs = spark.createDataFrame([(t, i, 0) for i, t in enumerate(texts)], "text string, doc_id long, n int").repartition(5)
    manifest = shards.write_shards(docs, f"file://{tmp_path}/out", length=length, per_shard=per_shard).collect()
    got = texts_of(stream(tmp_path / "out", manifest, length), model.eos_id())
    assert sorted(got) == sorted(tuple(model.encode(t or "")) for t in texts)


def test_rows_that_move_between_runs(spark, tmp_path):
    """The stream is fixed by the saved runs: an input that is shuffled anew at every reading still gives whole texts."""
    docs = spark.range(400).selectExpr("repeat(concat('t', id, ' '), 30) AS text", "rand() AS r").repartition(6).sortWithinPartitions("r").drop("r")
    manifest = shards.write_shards(docs, f"file://{tmp_path}/out", "bytes", 64, 8).collect()
    got = texts_of(stream(tmp_path / "out", manifest, 64), 256)
    assert sorted(bytes(t).decode() for t in got) == sorted(f"t{i} " * 30 for i in range(400))


def test_no_texts(spark, tmp_path):
    docs = spark.createDataFrame([], "text string")
    assert shards.write_shards(docs, f"file://{tmp_path}/out").count() == 0
