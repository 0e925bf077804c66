"""Awkward rows for every operator: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and to in that was with for on river stone paper green window walk quiet market letter garden".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if i % 12 == 11 else "") for i in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, _text string, node long, kept boolean, key string, word string, class int, _node long, _id string, _one int"


@pytest.fixture(scope="session")
def awkward(spark):
    base = prose(300, 1)
    texts = [
        (1, base), (2, base), (3, base.replace("river", "creek", 1)), (4, None), (5, ""), (6, " \t\n\x0b "), (7, "word"), (8, "a" * 50_000), (9, prose(20_000, 2)), (10, "née ñandú 😀 <|im_end|> \\ <b>&amp;</b>"),
        (11, "same line\n" * 40), (12, prose(80, 3)), (12, prose(80, 3)), (None, prose(90, 4)), (None, prose(90, 4)), (None, None), (13, "\x00\x01 MIT License mit license"), (14, prose(60, 5)), (14, prose(61, 6)),
    ]
    return spark.createDataFrame([(i, t, None, "src", None, 0.5, "r", "t", 7, True, "k", "w", 1, 5, "i", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
