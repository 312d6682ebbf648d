import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm.bpe import Bpe, encode_digests, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
BPE, LIB = Bpe(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab '<|endoftext|>\n\té漢", max_size=60), max_size=5))
def test_as_the_library(texts):
    ids = BPE.encode(texts)
    assert ids == [LIB.encode(t, add_special_tokens=False).ids for t in texts]
    assert [BPE.decode(x) for x in ids] == [LIB.decode(x, skip_special_tokens=False) for x in ids]


def test_tables(spark):
    r = random.Random(2)
    rows = [(0, None), (1, ""), (2, "a" * 30_000), (3, "a<|endoftext|> b"), (3, "a<|endoftext|> b"), (4, "".join(chr(r.randrange(1, 0x3000)) for _ in range(500)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    out = sorted((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in encode_digests(df, PATH).collect())
    want = []
    for i, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == sorted(want)
    assert {x.doc_id: x.decoded for x in encode_documents(df, PATH).collect()}[2] == "a" * 30_000
    assert encode_digests(df.limit(0), PATH).count() == 0
