"""BPE, prefix counts and packing against the libraries, plain versions and round trips."""

import random
from collections import Counter as Bag

import numpy as np
import public_tokenizers
import pytest
from quillwork.llm import bpe, packing, prefix_counts
from tokenizers import Tokenizer

ODD = ["", "  ", " a", "a ", "a  b", "\n\n x \n y  ", "don't 've  I'm", "émigré 中文 字 🎉🎉‍ x", " x   y", "a\n b\t c", " \t", "x" * 3000, "ab" * 2000 + " " + "#" * 999, "́ a ́", "<|endoftext|> hi <|startoftext|>x<|endoftext|>", "ΑΣ ΟΔΟΣ İI ß"]


def texts(n=400):
    random.seed(7)
    parts = ["a", "b", "é", " ", "  ", "\n", "'s", "'", ".", "1", "中", "́", " ", "T", "Σ", "<|endoftext|>", "\t", "the", "ing"]
    return ODD + ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark, small):
    docs = [(r.doc_id, r.text, 1) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    extra = [(10**6 + k, t, 2) for k, t in enumerate([*texts(), None])]
    return spark.createDataFrame(docs + extra + extra[-1:], "doc_id long, text string, Ids int")


def test_bpe_is_the_librarys(spark, rows):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = packing.tokenizer(path, pattern)
    out = bpe.encode(rows, path, pattern, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    found = out.collect()
    assert len(found) == rows.count()
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    again = bpe.decode(out.select("doc_id", "ids"), path, pattern).where("doc_id = 1000007").first()
    assert bytes(again.decoded) == texts()[7].encode()
    assert bpe.encode(rows.limit(0), path, pattern).count() == 0


def test_prefix_counts_are_the_librarys(rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    found = prefix_counts.prefix_counts(rows, path).withColumn("n", prefix_counts.total_tokens()).withColumn("cut", prefix_counts.prefix_within(20)).collect()
    for r in found:
        text = r.text or ""
        assert r.n == len(own.encode(text, add_special_tokens=False).ids), text
        assert r.prefix_ends[-1] == len(text)
        assert len(own.encode(text[: r.cut], add_special_tokens=False).ids) <= 20


def test_every_prefix():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, counter = Tokenizer.from_file(path), prefix_counts.counter(path)
    for text in texts(60):
        for k in range(0, min(len(text), 60) + 1, 3):
            assert counter.at(text, k) == len(own.encode(text[:k], add_special_tokens=False).ids), (text, k)
    for word in ("hello", "zzzzzqq", "ththesend", "aaaaaaa"):
        assert counter.prefixes(word) == [len(own.model.tokenize(word[:k])) for k in range(1, len(word) + 1)]


def test_longest_prefix_within_a_budget(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, counter = Tokenizer.from_file(path), prefix_counts.counter(path)
    spaceless = ["\u6a5f\u68b0\u5b66\u7fd2\u306f\u30c7\u30fc\u30bf\u304b\u3089\u5b66\u3076\u3002" * 4, "one\ntwo\tthree\n\nfour's they'll've\tx'r'rex", "https://example.org/a-b_c?d=e&f=1234567890", "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 3, "e\u0301te\u0301\u0130stanbul", "\u304b\u3099\u3002\u304b\u3000a!b\u0301'll?'re\u00bfx", "ab<|endoftext|>cd<|startoftext|>'ll", "'" * 5 + "lllll'll'd", "a" * 60, "", "\n\n x  y "]
    for text in [*spaceless, *(t[:70] for t in texts(40))]:
        n = [0, *(len(own.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1))]
        for budget in range(max(n) + 2):
            assert counter.within(text, budget) == max(k for k in range(len(n)) if n[k] <= budget), (text, budget)
    df = spark.createDataFrame([(0, spaceless[0] * 300), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r.prefix_within for r in prefix_counts.prefix_counts(df, path, budget=2048).collect()}
    count = lambda k: len(own.encode((spaceless[0] * 300)[:k], add_special_tokens=False).ids)
    assert got[1] == 0 and got[0] > 0 and count(got[0]) <= 2048 and all(count(got[0] + k) > 2048 for k in range(1, 50))


def plain_best_fit(sizes, length):
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(length - n)
    return sorted(rooms)


def test_best_fit_decreasing():
    random.seed(3)
    for _ in range(50):
        length = random.choice([1, 7, 64, 100])
        sizes = np.array([random.randint(1, length) for _ in range(random.randint(1, 80))])
        rows = packing.best_fit(sizes, length)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(length - sum(int(sizes[i]) for i in row) for row in rows) == plain_best_fit(sizes.tolist(), length)


def test_packing_loses_nothing(spark, rows):
    ids = packing.token_ids(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    packed = packing.pack(ids, 256, blocks=3, pad_id=9)
    want = Bag((r.doc_id, bytes(r.ids)) for r in ids.collect() if r.ids)
    parts = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in parts.items()} == {d: x for d, x in want}
    for r in packed.collect():
        line, place = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, np.uint16)
        assert len(line) == len(place) == 256 and r.cu_seqlens[-1] == r.n_tokens
        assert (line[r.n_tokens :] == 9).all()
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert place[a:b].tolist() == list(range(b - a))
    assert packing.pack(ids.limit(0), blocks=1).count() == 0
