import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from samples import prose
from sonda.llm import token_counts, token_files
from sonda.llm.encoding import Encoder
from sonda.llm.queries import tokenizer
from sonda.llm.transducer import Transducer

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in (BYTE, WORD)}


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(3)
    out = ["", "'", " ", "don't we'll they've'sx 'll 'r 're'", "a  b\n\n c\t d", "''s !'s", "x's's 1'2's", "日本語テキスト 12 ³½", "x<|endoftext|>y  <|endoftext|>", "<|startoftext|> a", "a\r\nb", "ǅungla ĲJ ŉ", "tail ", "\n'\n's", "x" * 4000, "ab" * 900 + " " + "z" * 700, "İstanbul Σας ΑΣ"]
    out += ["".join(rnd.choice("ab's tlrevmd \n1!é日<É.") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    out += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 900))) for _ in range(60)]
    return out + [prose(9, 2000)]


@pytest.mark.parametrize("most_states", [200_000, 50])
def test_transducer_counts_as_the_library(library, odd, most_states):
    t = Transducer(tokenizer(BYTE), most_states)
    want = [len(e.ids) for e in library[BYTE].encode_batch(odd, add_special_tokens=False)]
    for lo in range(0, len(odd), 400):
        assert token_counts.count_texts(t, pa.array(odd[lo : lo + 400])).tolist() == want[lo : lo + 400]


@pytest.mark.parametrize("name, dtype", [(BYTE, "<u4"), (WORD, "<u2")])
def test_encoder_equals_the_library(library, odd, name, dtype):
    e = Encoder(tokenizer(name), dtype)
    e.pieces.most = e.words.most = e.firsts.most = 100  # begun anew often
    for text, want in zip(odd, library[name].encode_batch(odd, add_special_tokens=False)):
        assert np.frombuffer(e.ids(text), dtype).tolist() == want.ids
    with pytest.raises(ValueError):
        Encoder(tokenizer(name), "|u1")


def test_counts_on_spark(edge, edge_rows, nothing, library):
    got = token_counts.token_counts(edge, tokenizer(BYTE)).collect()
    want = sorted((str(i), len((t or "").encode()), len(library[BYTE].encode(t or "", add_special_tokens=False).ids)) for i, t in edge_rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(nothing, tokenizer(BYTE)).count() == 0


def test_files_round_trip(spark, edge, edge_rows, nothing, library, tmp_path):
    files = token_files.write(edge, tokenizer(WORD), 2, f"file://{tmp_path}/tokens")
    rows = sorted(((i is not None, i or 0, t or "") for i, t in edge_rows))
    ids = [np.array([*library[WORD].encode(t, add_special_tokens=False).ids, 2], "<u4") for _, _, t in rows]
    assert files.n_docs == len(rows) and files.n_ids == sum(map(len, ids))
    for k, want in enumerate(ids):
        assert files.document(k).tolist() == want.tolist()
    got = sorted((r["start"], r["id"], r["n_tokens"], r["ids_crc32"]) for r in files.read(spark).collect())
    starts = np.cumsum([0, *map(len, ids)])
    assert got == [(int(starts[k]), r[1] if r[0] else None, len(ids[k]), zlib.crc32(ids[k])) for k, r in enumerate(rows)]
    on_disk = [f for f in os.listdir(tmp_path / "tokens") if f.endswith(".bin")]
    assert sum(os.path.getsize(tmp_path / "tokens" / f) for f in on_disk) == 2 * files.n_ids
    empty = token_files.write(nothing, tokenizer(WORD), 2, f"file://{tmp_path}/none")
    assert empty.n_docs == 0 and empty.read(spark).count() == 0


@pytest.mark.parametrize("kind", ["x", "=-", "abcab", "letters", "日本"])
def test_long_runs_without_a_start(library, kind):
    """Chunks without a pre-token start: the library's counts, and time in proportion to length."""
    rnd = random.Random(6)
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(120_000)) if kind == "letters" else kind * (120_000 // len(kind))
    t = Transducer(tokenizer(BYTE))
    texts = ["some words before", text, text[:70_001], "and after"]
    began = time.time()
    got = token_counts.count_texts(t, pa.array(texts)).tolist()
    assert time.time() - began < 6
    assert got == [len(e.ids) for e in library[BYTE].encode_batch(texts, add_special_tokens=False)]
