import random

import pytest

#: Names that operators use inside; extra columns of the documents carry them.
CLASHING = ["size", "key", "node", "label", "hash", "kept", "source_key", "copy", "payload", "x", "rank"]


def _texts() -> list:
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(300)]
    passage = " ".join(draw.choice(words) for _ in range(70))
    sentence = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [None, "", "   \n\t", "one", "two words", "one", " ".join(["same"] * 400), "aaaa" * 200, "long " + sentence(9000)]
    texts += [sentence(draw.randint(3, 120)) for _ in range(40)]
    texts += [sentence(30) + " " + passage + "\n" + sentence(25) for _ in range(6)]
    texts += [texts[12], texts[12], texts[12] + " ", "  " + texts[20]]
    base = sentence(200).split()
    for k in range(8):
        edited = list(base)
        edited[10 + 20 * k] = f"edit{k}"
        texts.append(" ".join(edited))
    return texts


@pytest.fixture(scope="session")
def messy(spark):
    """Null, empty, blank, tiny and very long texts, copies, near copies, shared passages, a null id, repeated rows, clashing columns."""
    rows = [(k, t, ["en", "fr", None][k % 3], [None, "src0", "src0", "src1"][k % 4]) for k, t in enumerate(_texts())]
    rows += [(None, "a row without an id", "en", "src2"), (None, None, None, None)]
    rows += [rows[15], rows[15]]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([r + tuple(range(len(CLASHING))) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("1 = 0")
