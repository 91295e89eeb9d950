import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from weftcast.llm import bpe, pretoken, scan, tokenbin

from .conftest import ODD

RANKS = P.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed):
    rnd = random.Random(seed)
    letters = list("aZé'srtevl dm  \n\t1²中 !?  \u0085\x1c\x1f​😀_-'’")
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    table = bpe.PerfectHash(keys)
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys + np.uint64(1)) == -1).all()


def test_encoding_equals_the_library():
    known, own = reference(), bpe.ByteBpe(bpe.read_ranks(RANKS))
    texts = [*noise(3000, 3), "", "'s", "x's", "it's 'special' 're'll''s", "a'", " 's", "\n's", "a" * 5000, "﻿  x"]
    encoder, got = pretoken.PieceEncoder(own.pieces, limit=500), []
    for part in scan.chunks(pa.array(texts), 3000):
        ids, counts = encoder.ids(part)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [known.encode_ordinary(t) for t in texts]


def test_digests(spark, docs):
    known = reference()
    rows = ODD + [(100 + k, t) for k, t in enumerate(noise(200, 5))]
    got = sorted(map(tuple, bpe.encoding_digests(docs(rows), RANKS).collect()), key=str)
    want = []
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe.encode_documents(docs(ODD), RANKS).collect()
    assert all(bytes(r["decoded"]) == known.decode(list(r["ids"])).encode() for r in full)
    assert bpe.encoding_digests(docs([]), RANKS).count() == 0


def test_packed_values_return():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 1000):
        values = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        assert (tokenbin.unpack(*tokenbin.pack(values), n) == values).all()


def test_token_files(spark, docs, monkeypatch):
    import zlib

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [(k, t) for k, t in enumerate(noise(300, 7))] + [(1000, None), (1001, "")]
    random.Random(1).shuffle(rows)
    got = sorted(map(tuple, tokenbin.token_digests(tokenbin.write_token_files(docs(rows), P.path("byte_bpe_50k.json"), 2, files=3)).collect()))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    segments = tokenbin.write_token_files(docs(ODD), P.path("byte_bpe_50k.json"), 2, files=2)
    assert tokenbin.read_token_files(segments).count() == len(ODD)
    assert tokenbin.read_token_files(tokenbin.write_token_files(docs([]), P.path("byte_bpe_50k.json"), 2)).count() == 0


def test_added_tokens_in_texts(spark, docs):
    import zlib

    end, tokenizer = "<|endoftext|>", Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [end, f"a {end} b", f"a  {end}{end}\n{end}é's", "<|endof", f"text|>{end}", "", f"{end}'s x  ", None, "plain", f"<|endoftext{end}|>", f"x{end}"]
    texts += [end.join(noise(4, k)) for k in range(50)]
    got = sorted(map(tuple, tokenbin.token_digests(tokenbin.write_token_files(docs(list(enumerate(texts))), P.path("byte_bpe_50k.json"), 2, files=2)).collect()))
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
