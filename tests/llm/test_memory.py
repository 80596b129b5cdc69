"""What the text operators hold beside their Arrow batches: two tasks of an executor, JVM included, share 3,000 MB."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from quillwork.llm import bpe, minhash, quality, substrings
from quillwork.llm.arrowtext import chunks, grid, release, shingles


def _held(run) -> float:
    """The most MB that ``run`` held at once."""
    release()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _texts(mb: int, words: int) -> list[str]:
    numbers = np.random.default_rng(5).integers(0, words, mb * 1_000_000 // 7)
    return [" ".join(f"w{n:05d}" for n in part) for part in np.array_split(numbers, mb * 500)]


def test_steps_over_words_hold_little():
    texts = pa.array(_texts(2, 50_000))

    def windows(part):
        g = grid(part)
        values, at = shingles(g.words(), g.doc, 5)
        first = np.searchsorted(g.doc[at], np.arange(len(g) + 1))
        for fn in range(substrings.HASHES):
            substrings.compact_windows(substrings.hashed(values, fn), first, 46)

    def signatures(part):
        doc, runs, times = minhash.bags(grid(part), 5)
        minhash.signatures(doc, runs, times, len(part), 96)

    for step in (windows, signatures, lambda part: quality.measure(part, 5, 10)):
        assert _held(lambda: [step(texts.slice(a, b - a)) for a, b in chunks(texts)]) < 30  # noqa: B023


def test_a_codec_remembers_little():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = _texts(2, 1_000_000)
    alone = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    last = alone.encode(texts[-3:])
    for at in range(0, len(texts), 100):
        ids = codec.encode(texts[at : at + 100])
        assert len(codec.pieces) <= 50_000 and len(codec.words) <= 50_000
    assert ids[-3:] == last and [codec.decode(x).decode() for x in ids] == texts[-100:]
