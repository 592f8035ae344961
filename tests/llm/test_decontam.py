"""Planted benchmark items with edits up to a tenth of their characters."""

import random
import time

from bidgraph.llm import decontam


def edited(rng, text, edits):
    """``text`` after so many replacements, insertions and deletions."""
    chars = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[i] = rng.choice("qxzjk")
        elif kind == 1:
            chars.insert(i, rng.choice("qxzjk"))
        else:
            del chars[i]
    return "".join(chars)


def test_a_tenth_of_edits_is_found():
    rng = random.Random(5)
    words = "market river tender company award council bridge paper winter contract school garden minister report".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(10, 24))) for _ in range(30)]
    items = [decontam.Item(i, t, decontam.budget(len(t))) for i, t in enumerate(texts)]
    assert all(x.edits == len(x.text) // 10 for x in items)
    matcher = decontam.Matcher(items)
    for _ in range(20):
        for item in items:
            part = edited(rng, item.text, item.edits)
            text = "some other words " + part + " and what follows"
            least = decontam.nearest(item.text, decontam.normal(text))
            assert matcher.find(text).get(item.item_id, 99) == least if least <= item.edits else True


def test_a_replaced_word_does_not_hide_an_item():
    text = "the council of the river towns met again in winter and spoke about the old bridges and mills"
    item = decontam.Item(1, text, decontam.budget(len(text)))
    assert 1 in decontam.Matcher([item]).find("before " + text.replace("councils", "x").replace("bridges", "gardenxy"))


def test_short_items_stand_between_ends_of_words():
    matcher = decontam.Matcher([decontam.Item(1, "one two", 0), decontam.Item(2, "a", 0)])
    assert matcher.find("gone twofold banana") == {} and matcher.find("gone one twofold") == {}
    assert matcher.find("One, two!") == {1: 0} and matcher.find("it is a banana") == {2: 0} and matcher.find("gone two one two") == {1: 0}


def shared_piece_items(rng, n):
    words = [f"{a}{b}{c}" for a in ("bri", "mar", "sto", "ple", "gar") for b in ("nda", "keto", "ri", "svu") for c in ("l", "nt", "re", "sk")]
    said = lambda: " ".join(rng.choices(words, k=rng.randint(5, 9)))
    return [decontam.Item(i, t, decontam.budget(len(t))) for i in range(n) for t in [f"{said()} which of the following {said()}"]]


def test_items_that_share_pieces_are_found_together(monkeypatch):
    rng = random.Random(6)
    items = shared_piece_items(rng, 80)
    texts = [f"some {edited(rng, i.text, rng.randint(0, i.edits))} more" for i in items] + ["which of the following " * 10]
    monkeypatch.setattr(decontam, "HOT_PIECE", 1)
    filed = decontam.Matcher(items)
    monkeypatch.setattr(decontam, "HOT_PIECE", 10**9)
    listed = decontam.Matcher(items)
    found = [filed.find(t) for t in texts]
    assert found == [listed.find(t) for t in texts] and sum(map(bool, found)) > 60


def test_ten_thousand_items_with_one_piece():
    rng = random.Random(7)
    items = shared_piece_items(rng, 10_000)
    matcher = decontam.Matcher(items)
    began = time.time()
    assert matcher.find("he asked which of the following is so " * 500) == {}
    assert time.time() - began < 10
    assert matcher.find(f"x {items[77].text} y")[77] == 0


def test_blocks_equal_one_block(spark):
    rng = random.Random(8)
    items = shared_piece_items(rng, 60)
    bench = spark.createDataFrame([(i.item_id, i.text) for i in items], "item_id long, text string")
    texts = [None, "", *(f"some {edited(rng, i.text, rng.randint(0, i.edits))} more" for i in items)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    run = lambda **kw: {r.doc_id: [tuple(x) for x in r.benchmark_items] for r in decontam.match_documents(docs, bench, **kw).collect()}
    one = run()
    assert one == run(block_chars=800) and sum(map(bool, one.values())) > 50
