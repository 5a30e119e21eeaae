import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, pos int, h1 string"

#: Every awkward row at once: nulls, empties, blanks, ties, repeats, long texts, odd characters.
_rng = random.Random(5)
_vocabulary = [f"{a}{b}" for a in ("ra", "so", "mi", "té", "la", "no") for b in ("ter", "ling", "gar", "ñu", "sen", "dol", "")]


def prose(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(_vocabulary) + r.choice(_vocabulary) for _ in range(n)]


def lines(words: list[str], width: int = 9) -> str:
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def awkward_rows() -> list[tuple]:
    base = prose(220, 1)
    near = list(base)
    near[100] = "changed"
    shared = prose(70, 2)
    texts = [
        (1, None), (2, ""), (3, " \t\n \r "), (4, "one"), (5, "One two three"), (6, lines(base)), (7, lines(base)), (8, lines(near)), (8, lines(near)),
        (9, lines(prose(150, 3) + shared + prose(90, 4))), (10, lines(prose(40, 5) + shared + prose(200, 6))), (11, "\n".join(["The same line again and again"] * 5)),
        (12, "the SAME line again and again \nother line of text here"), (13, "x" * 70_000), (14, " ".join(prose(9_000, 7))), (15, "123 456 ### $$$"), (16, "日本語 テキスト 🙂 <|endoftext|> it's á \x1c 　 end"),
        (None, lines(base)), (None, None), (17, "Under the MIT License. Apache License, Version 2.0 and CC BY-NC 4.0\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND ISC"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None, None if t is None else len(t), "x", 1, "y") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def work(spark, request):
    from cairn.llm.common import WorkTables

    return WorkTables(spark, "test")
