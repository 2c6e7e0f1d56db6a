import random
import string

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house use place during high without again home around small however found mrs part thought went say general once upon school every".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) if n else ""


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, copies and columns whose names clash with inner ones."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[3]] * 5 + [texts[4] + " end", "", "", None, "   ", prose(rng, 9000), "x" * 5000, "ÄÖ 中文 ß a", "two words"]
    rows = [(i, t, rng.choice(["en", "de", None]), f"src{i % 7}" if i % 9 else None, None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[0], "en", "src1", 3, "clash", 1), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def secret(rng, n, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))
