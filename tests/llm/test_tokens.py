import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tessitura.llm import subwords, token_files as F

from .conftest import ODD

TEXTS = [
    "a b ć ́x", "Σ ΑΣ ς", "it's 's 'll don't,", "\t\r a\x85b c", "ﬁ ½ é 12 345", "\x00 a", "A" * 50, "İstanbul ÀÉ, x.,!", "ªº ǅ ŉ ß. 'tis 12. a1, ²,",
    "a\xa0b, c d", "“q”, ñ.", "É,É. a×,b ÷. 'S.'s x.'s l'a,b's", "", None, "..,, a..b,,c", "日本,語. ok", "Hello, World! The end.",
]


@pytest.fixture(scope="module")
def encoder():
    return subwords.Encoder(subwords.vocabulary_path())


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_tokenizers_ids(encoder):
    rng = random.Random(2)
    letters = "abcdeABCDEéÉß.,;:!?'|#* \n\t09漢Σ"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)]
    for _ in range(2):  # with an empty and a filled table
        ids, n = encoder.encode(pa.array(texts))
        stop = np.cumsum(n)
        for t, a, b in zip(texts, [0, *stop], stop):
            assert ids[a:b].tolist() == direct(encoder, t), t


def test_special_names(encoder):
    texts = ["<|endoftext|> hi <|startoftext|>x", "<|ENDOFTEXT|>", "a <| b"]
    ids, n = encoder.encode(pa.array(texts))
    assert n.tolist() == [len(direct(encoder, t)) for t in texts]


def test_frames_round_trip():
    out = io.BytesIO()
    w = F.FrameWriter(out)
    docs = [(None, b""), (3, np.arange(5, dtype="<u4").tobytes()), (9, np.arange(90000, dtype="<u4").tobytes())]
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = F.FrameReader(out)
    assert r.doc_ids == [None, 3, 9] and r.n_tokens.tolist() == [0, 5, 90000]
    assert [r.ids(i).tobytes() for i in range(3)] == [x for _, x in docs]
    assert [d for d, _ in r.find([9])] == [9]
    # Any zstandard reader unpacks the frames and skips the table.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain.startswith(docs[1][1] + docs[2][1])
    data = bytearray(out.getvalue())
    data[int(r.at[2]) + 20] ^= 1
    with pytest.raises(Exception):
        F.FrameReader(io.BytesIO(bytes(data))).ids(2)


def test_files(spark, docs, tmp_path, encoder):
    rng = random.Random(4)
    rows = [(i, rng.choice(TEXTS[:-5])) for i in rng.sample(range(1000), 80)] + [(2000 + i, t) for i, (_, t) in enumerate(ODD)] + [(5, "x"), (5, "y"), (None, "z")]
    files = F.write_token_files(docs(*rows), str(tmp_path / "tokens"))
    out = [r.asDict() for r in F.read_token_files(spark, files).collect()]
    assert len(out) == len(rows) and sum(n for _, n, _ in files.files) == len(rows)
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    texts = {d: t for d, t in rows if d not in (5, None)}
    for r in out:
        if r["doc_id"] in texts:
            want = np.array([*direct(encoder, texts[r["doc_id"]]), 1], "<u4").tobytes()
            assert r["ids"] == want and r["ids_crc32"] == zlib.crc32(want) and r["n_tokens"] == len(want) // 4
    empty = F.write_token_files(docs((1, "a")).limit(0), str(tmp_path / "none"))
    assert F.read_token_files(spark, empty).count() == 0
