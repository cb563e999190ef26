import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, score string, node long, row long, size int, bucket long"


def _texts():
    rng = random.Random(3)
    words = [a + b for a in "ba ce di fo gu ka le mi no pu ra se".split() for b in "n r t l s x".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(12)
    out = [None, "", " \n\t ", "one", "two words", "x" * 5000, "\n".join([shared] * 5), prose(30)]
    for i in range(60):
        lines = [prose(rng.randint(5, 25)) for _ in range(rng.randint(2, 8))]
        if i % 3 == 0:
            lines.insert(1, "  " + shared + " ")
        out.append("\n".join(lines))
    base = out[20]
    for i in range(12):  # near copies, an edit each
        w = base.split(" ")
        w[(i * 7) % len(w)] = f"edit{i}"
        out.append(" ".join(w))
    out += [base] * 5 + [base.upper()]
    out.append(prose(20_000))
    out += ["a@b.c mail", "ip 10.0.0.1 and 300.1.1.1", "card 4111 1111 1111 1111 no 4111 1111 1111 1112", "call +1 (988) 555-2485 now", "This is under the Apache License, Version 2.0 é 漢字 😀"]
    return out


@pytest.fixture(scope="session")
def rows():
    """Texts with all the odd cases; a repeated row, a null id and one id with two texts at the end."""
    t = _texts()
    out = [(i, x, "en", f"s{i % 9}" if i % 11 else None, None if x is None else len(x)) for i, x in enumerate(t)]
    return [*out, out[25], (None, t[30], None, None, None), (7, t[31], "en", "s1", 1)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*r, None, "x", "y", 1, 2, 3, 4) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
