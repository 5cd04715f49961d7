"""Packing of parsed pages: as small as at the highest level, nearly, for a part of its time."""

import json
import random
import time

import zstandard

from marketspark.llm import htmltext


def test_packing_is_much_cheaper_than_the_highest_level():
    rng = random.Random(0)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["an", "ti", "on", "er", "th", "in", "re", "ou"]) for _ in range(rng.randrange(1, 5)))
    pages = []
    for _ in range(150):
        paragraphs = "".join(f"<p class='story'>{' '.join(word() for _ in range(60))}</p>" for _ in range(12))
        pages.append(json.dumps(list(zip(*htmltext.parse(f"<body><nav>Home News</nav><article>{paragraphs}</article></body>"), strict=True))).encode())

    def pack(by):
        took = []
        for _ in range(3):
            start = time.process_time()
            out = [by.compress(p) for p in pages]
            took.append(time.process_time() - start)
        return min(took), out

    took, out = pack(htmltext.packer())
    most, smallest = pack(zstandard.ZstdCompressor(level=19))
    assert [zstandard.decompress(x) for x in out] == pages
    assert sum(map(len, out)) <= 1.03 * sum(map(len, smallest))
    assert took <= 0.6 * most, (took, most)
