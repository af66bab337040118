import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from logtide.llm import pieces
from logtide.llm.queries import QUERIES, piece_model

LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
ENCODER = pieces.PieceEncoder(piece_model())
TEXTS = ["", " ", "  a  b ", "\n\t x", "Hello  wörld　ﬁ ①½ ＡＢＣ", "▁ literal", "中文字 𝒳𝒴 🙂👩‍👩‍👧", "á è",
         "é" * 300, "<s> </s> <unk> <0x0A>", "\x00\x01 z", "word " * 50, "ㄱㅏ각", "…ǅ㍿ ﷺ"]


def with_map(rule, **spec):
    """The public model with a built-in character map of the library and other flags."""
    proto = model_pb.ModelProto()
    proto.ParseFromString(piece_model())
    other = model_pb.ModelProto()
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    for name, value in spec.items():
        setattr(proto.normalizer_spec, name, value)
    return proto.SerializeToString()


def same(encoder, library, text):
    """Ids and byte spans beside the library's own."""
    got = encoder.encode(text)
    assert got.ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
    wanted = library.encode(text, return_type="offset_mapping", return_bytes=True)["offsets"]
    assert list(zip(got.begins[1:-1].tolist(), got.ends[1:-1].tolist())) == [tuple(x) for x in wanted]
    assert got.ends.max() <= len(text.encode())


@pytest.mark.parametrize("text", TEXTS)
def test_public_model(text):
    same(ENCODER, LIBRARY, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_longest_prefix_normalisation_with_alignment(rule, trim, prefix):
    model = with_map(rule, remove_extra_whitespaces=trim, add_dummy_prefix=prefix)
    encoder, library = pieces.PieceEncoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert encoder.map.units
    rng = random.Random(8)
    alphabet = "aB é　ﬁ①½ＡㄱㅏǺ \t\n🙂中…ǅ㍿​"
    for text in [*TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(150))]:
        same(encoder, library, text)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    same(ENCODER, LIBRARY, text)


def test_spans_tile_the_text():
    for text in TEXTS:
        got = ENCODER.encode(text)
        assert got.ends[-1] == len(text.encode()) and (got.begins[1:] == got.ends[:-1])[1:].all()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_query_equals_the_library(spark, saved):
    rows = list(enumerate([*TEXTS, None, "long word " * 40_000, "x" * 100_000]))
    got = {r["doc_id"]: r for r in QUERIES["op2_sentencepiece"](spark, saved(rows)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == sha(np.array(ids, dtype="<u4").tobytes())
        assert got[k]["decoded_sha256"] == sha(LIBRARY.decode(ids).encode())


def test_odd_rows(spark, table):
    rows = [(None, None), (None, ""), (1, "a b"), (1, "a b")]
    df = table(rows).withColumns({"ids": F.lit("x"), "encoder": F.lit(1), "decoded": F.lit(2)})
    got = pieces.encode_documents(df, piece_model()).collect()
    assert len(got) == 4 and set(got[0].asDict()) == set(df.columns) | {"begins", "ends"}
    assert sorted(len(r["ids"]) for r in got) == [2, 2, 4, 4]
    assert pieces.encode_documents(df.limit(0), piece_model(), decode=True).count() == 0


#: Encodes 24 MB of texts as a task does and prints the MB that the process took meanwhile at most, and keeps afterwards.
WORKER = """
import random, re
import pyarrow as pa
from pyspark.sql import types as T
from logtide.llm import pieces
from logtide.llm.queries import piece_model

class Docs:
    columns, schema = ["text"], T.StructType([T.StructField("text", T.StringType())])
    def drop(self, *names):
        return self
    def mapInArrow(self, run, schema):
        return run

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    yield pa.record_batch([[" ".join(rng.choices(words, k=400)) for _ in range(10000)]], names=["text"])

run = pieces.encode_documents(Docs(), piece_model())
list(run(iter([pa.record_batch([["warm up"]], names=["text"])])))
given = batches()
batch, given = next(given), None
size, before, most, rows = batch.nbytes / 2 ** 20, held(), 0, 0
for part in run(iter([batch])):
    rows += part.num_rows
    most = max(most, held())
del batch, part
print(rows, size, most - before, held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_a_worker_gives_its_memory_back():
    """Workers outlive their tasks: what one took for its texts must not stay with it."""
    run = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, timeout=120, check=True,
                         cwd=Path(__file__).resolve().parents[2])
    rows, size, most, kept = map(float, run.stdout.split())
    assert rows == 10_000 and size > 20
    assert most < 100 and kept < 30, (most, kept)
