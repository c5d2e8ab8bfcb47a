"""Peak memory of kernels that visit whole texts, each in a process of its own."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import nearcopies, simhash

ROOT = Path(__file__).parents[2]


def grown(code):
    """MB by which ``code`` raises the peak memory of a process that holds the text."""
    lines = ["import resource, numpy as np", "from tessera.llm import decontaminate, nearcopies, quality, simhash", "import pyarrow as pa", "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10", code]
    return int(subprocess.run([sys.executable, "-c", "\n".join(lines)], cwd=ROOT, capture_output=True, text=True, check=True, timeout=600).stdout)


def test_fingerprints_of_a_long_text_of_short_words():
    text = "body = np.frombuffer(b'a b c d e f g h ' * (2 << 20), np.uint8); at = np.array([0, len(body)])"
    assert grown(f"{text}\nbefore = peak(); simhash.fingerprints(body, at); print(peak() - before)") < 150


@pytest.mark.parametrize("words", [3, 5])
def test_pieces_give_the_same_hashes(words):
    texts = [b"", b"one", b"a  b\n\nc d e f g", b"x" * 900 + b" y " + b"z" * 700, b" \t ", b"q w e r t y u i o p\x0b" * 40, " ".join(f"É{i}" for i in range(300)).encode()]
    body, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = simhash.fingerprints(body, at, words, 1 << 20)
    assert (simhash.fingerprints(body, at, words, 64) == whole).all()
    gather = lambda limit: {i: sorted(np.concatenate([h[b[k] : b[k + 1]] for lo, h, b in simhash.shingle_hashes(body, at, words, limit) for k in range(len(b) - 1) if lo + k == i] or [[]])) for i in range(len(texts))}
    assert gather(64) == gather(1 << 20)
    assert [i for i, _ in nearcopies.shingle_sets(body, at, words)] == list(range(len(texts)))


def test_one_pass_of_a_benchmark():
    items = "t = pa.table({'i': [str(k) for k in range(4000)], 't': [' '.join(f'w{x}' for x in row) for row in np.random.default_rng(1).integers(0, 50021, (4000, 165)).tolist()]})"
    assert grown(f"{items}\nassert 3 << 20 < t.nbytes < 5 << 20\nbefore = peak(); b = decontaminate.Benchmark(t, 10); assert len(b.patterns) > 550_000; print(peak() - before)") < 250


def test_features_of_a_long_text():
    text = "body = np.frombuffer(b'Some words, and a line of them\\n' * (1 << 20), np.uint8)"
    assert grown(f"{text}\nbefore = peak(); quality.long_features(body); print(peak() - before)") < 150
