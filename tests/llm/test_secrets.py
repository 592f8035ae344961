"""Random strings that look like identifiers, or stand beside base spans."""

import random
import re
import string

from bidgraph.llm import queries, secrets


def test_letters_and_groups_are_measured():
    tokens = secrets.encoding(queries.RANKS, queries.PATTERN)
    for word in ("qzxvkwpjhfzbtnmcrlsd", "ABCDE-FGHIJ-KLMNO-PQRST", "XKQZV-PWJTH-NBRCM-LDSFG", "name_qzxvkwpjhfzbtnmcrlsd_of_the_department_of_transportation"):
        assert secrets.is_random(word, tokens)
    for word in ("SUPPLY_CHAIN_MANAGEMENT_UNIT", "MAXIMUM_NUMBER_OF_RETRIES", "verantwoordelijkheid", "20240101-20241231-0001", "a-b-c-d-e-f-g-h-i-j-k-l-m", "--------------------", "2024-01-01-00-00-PM-XK"):
        assert not secrets.is_random(word, tokens)


def test_rest_beside_base_spans():
    tokens = secrets.encoding(queries.RANKS, queries.PATTERN)
    code, run, short = "xK9vQ2mZ7tLp4WnR8sYbJZ", "0123456789abcdef01234567", "xK9vQ2mZ7tLp"
    assert secrets.find_spans(f"{code}{run}", tokens, 2.0) == [("random", 0, 22), ("hex", 22, 46)]
    assert secrets.find_spans(f"{short}Z{run}ZR8sYbJ3WnQ", tokens, 2.0) == [("random", 0, 13), ("hex", 13, 37), ("random", 37, 48)]
    assert secrets.find_spans(f"see/{run}", tokens, 2.0) == [("hex", 4, 28)]


def test_rulers_take_linear_time():
    import time

    tokens = secrets.encoding(queries.RANKS, queries.PATTERN)
    for ruler in ("-" * 1_000_000 + "1a2b3", "a-" * 500_000 + "1a2b3", "token " + " " * 1_000_000, "=" * 1_000_000, "ab1" * 300_000):
        began = time.time()
        secrets.find_spans(ruler, tokens, 2.0)
        assert time.time() - began < 10


def test_identifier_parts_equal_one_pattern():
    rng = random.Random(9)
    part = "(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Za-z]{1,3}[0-9]{1,4})"
    whole = re.compile(f"[+/_=-]*(?:{part}[+/_=-]+)*{part}?[+/_=-]*")
    for _ in range(20_000):
        word = "".join(rng.choices("aBc1-_", k=rng.randint(0, 9)))
        assert secrets.is_identifier(word) == bool(whole.fullmatch(word)), word


def test_recall_of_random_strings_and_words_left_alone():
    """Keys of the usual alphabets are found; the words of the documents are not taken for keys."""
    import duckdb

    tokens = secrets.encoding(queries.RANKS, queries.PATTERN)
    rng = random.Random(10)
    b62 = string.ascii_letters + string.digits
    for alphabet, lengths, least in ((b62, (20, 24, 32, 64), 0.97), (b62 + "+/", (24, 40, 64), 0.97), (b62 + "-_", (32, 43), 0.95), (string.ascii_uppercase + "234567", (32, 52), 0.97), (string.ascii_letters, (32, 40), 0.95), (string.ascii_lowercase, (32, 40), 0.9)):
        for n in lengths:
            words = ["".join(rng.choices(alphabet, k=n)) for _ in range(400)]
            found = sum(any(k != "assign" for k, *_ in secrets.find_spans(f"see {w} there", tokens, 2.0)) for w in words)
            assert found >= least * len(words), (alphabet, n, found)
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    letters = sorted({w for (t,) in texts for w in re.findall(r"[A-Za-zÀ-ÿ]{20,}", t)})
    assert letters and sum(secrets.is_random(w, tokens) for w in letters) <= 0.01 * len(letters)
