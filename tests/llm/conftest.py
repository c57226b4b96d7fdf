import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS)[:3] for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, ties, repeated rows, odd characters."""
    base, line = prose(1, 120), "A shared line that is long enough to count as one, surely."
    near = base.split(" ")
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, base), (5, base), (6, " ".join(near[:60] + ["changed"] + near[61:])),
            (7, " ".join(["other"] * 3 + near[3:])), (8, prose(2, 3)), (9, prose(2, 3).upper()), (10, prose(3, 6000)),
            (11, "Released under the MIT License. cc-by-nc 4.0 under THE mit\nlicense"), (12, "spdx-license-identifier: GPL-3.0"),
            (13, "ein Wörtchen ñandú 日本語 🙂 \x00 end"), (13, "ein Wörtchen ñandú 日本語 🙂 \x00 end"), (14, "one two three four five " * 40),
            (15, "x" * 5000), (16, "<|endoftext|> a  b\n\nc 's"), (17, "!!! ### $$$ %%% &&& *** <<< >>> ||| ???"), (None, base), (None, "")]
    rows += [(20 + i, f"{prose(50 + i, 30)}\n{line if i % 2 else '  ' + line.upper() + ' '}\n{prose(70 + i, 20)}") for i in range(7)]
    rows += [(40 + i, f"{prose(90 + i, 40)} {prose(7, 35)} {prose(130 + i, 25)}") for i in range(5)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The rows, with columns whose names operators use themselves."""
    rows = [(d, t, "en" if i % 2 else None, f"s{i % 2}", 7, "z", True) for i, (d, t) in enumerate(edge_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, comp string, drop boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
