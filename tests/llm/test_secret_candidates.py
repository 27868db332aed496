import random
import string

import pytest

from gridfold.llm import secret_scan as S

WORDS = {w: 5 for w in "thention erandle whole neither above mention orbit season little planet".split()}


@pytest.fixture(scope="module")
def judge():
    reader, forest = S.train(WORDS)

    def secrets(text):
        return [text[a:b] for a, b, p in S._judge(reader, forest, [text], 0.5)[0] if p >= 0.5]

    return secrets


def test_keys_without_a_digit_are_found(judge):
    rng = random.Random(1)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    capitals, letters = string.ascii_uppercase, string.ascii_letters
    keys = [make() for make in (
        lambda: "AKIA" + draw(capitals, 16), lambda: "ASIA" + draw(capitals, 16), lambda: "ghp_" + draw(letters, 36),
        lambda: "sk_live_" + draw(letters, 24), lambda: draw(letters, 20), lambda: draw(letters, 32),
    ) for _ in range(50)]
    assert sum(judge(f"whole orbit {k} of the season") == [k] for k in keys) >= 0.98 * len(keys)


def test_long_words_paths_and_rules_are_not(judge):
    rng = random.Random(2)
    join = lambda by, k: by.join(rng.choice(sorted(WORDS)) for _ in range(k))
    fine = [join("", 4), join("", 4).upper(), join("-", 4), join("/", 4), join("_", 4), "=" * 30, "-" * 20] * 20
    assert sum(judge(f"whole orbit {t} of the season") == [] for t in fine) >= 0.98 * len(fine)


@pytest.mark.parametrize("text, value", [
    ('password="a7,k2;Q<x>e!f" next', "a7,k2;Q<x>e!f"),
    ("password=q7,k2Zx9'w1 next", "q7,k2Zx9'w1"),
    ("<b>password=q7k2Zx9w1pL</b>", "q7k2Zx9w1pL"),
    ("password=q7k2Zx9w1pL,user=bob", "q7k2Zx9w1pL"),
    ('{"token": "x4, y9;Zk2Q", "n": 1}', "x4, y9;Zk2Q"),
])
def test_a_named_value_is_taken_whole(text, value):
    assert [text[a:b] for a, b in S.Reader(WORDS).candidates(text)] == [value]


def test_coverage_reads_the_whole_candidate():
    reader = S.Reader(WORDS)
    text = "x" * 4096 + "mention" * 2048
    assert reader.covered("mention" * 5) == 1
    assert reader.features(text, 0, len(text))[S.FEATURES.index("covered")] == 7 * 2048 / len(text)


def test_words_after_a_candidate_count(judge):
    rng = random.Random(4)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(50)]
    assert sum(judge(f"whole orbit {k} is the commit") == [] for k in keys) >= 48
    assert sum(judge(f"whole orbit {k} above season planet") == [k] for k in keys) >= 48


def test_words_before_a_line_break(spark):
    df = spark.createDataFrame([(1, "whole orbit ends\n"), (2, "whole\n orbit Season ends\n"), (3, None), (4, "")], "doc_id long, text string")
    assert S.dictionary(df) == {"orbit": 2, "whole": 1}
    S.Reader({"ends\n": 3, "a{b": 1})  # any string may be a word of a caller's list
    assert S.scan_documents(df).count() == 4
