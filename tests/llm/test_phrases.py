import hashlib
import random

import numpy as np
import pytest

from tabloom.llm import phrases
from tests.llm.fixtures import DOC_SCHEMA, awkward, awkward_rows, empty


def _text(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(n))


def test_neighbours_in_a_batch_do_not_matter():
    rnd = random.Random(1)
    texts = [_text(rnd, rnd.randrange(0, 60)).encode() for _ in range(40)] + [b"", b"a", b"aa", b"ab", b"a" * 999]
    together = phrases.signatures(texts)
    for t, s in zip(texts, together):
        assert (phrases.signatures([t])[0] == s).all()


def test_equal_substrings_share_phrases_at_any_offset():
    rnd = random.Random(2)
    body = _text(rnd, 400)
    own = set(phrases.signatures([body.encode()], width=10**6)[0].tolist())
    for shift in (1, 2, 3, 7, 50):
        moved = set(phrases.signatures([(_text(rnd, 60)[:shift] + body).encode()], width=10**6)[0].tolist())
        assert len(own & moved) > 0.95 * len(own)


def test_phrases_have_at_least_two_symbols_inside_a_text():
    rnd = random.Random(3)
    x = np.frombuffer(_text(rnd, 3000).encode(), dtype=np.uint8)
    first = np.zeros(len(x), dtype=bool)
    first[0] = True
    names, _ = phrases.parse_level(x, first)
    assert len(x) / 6 < len(names) < len(x) / 2


def test_likeness():
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4], np.uint32)
    none = np.zeros(0, np.uint32)
    assert phrases.likeness(a, b) == 0.5 and phrases.likeness(a, a) == 1
    assert phrases.likeness(none, none) == 1 and phrases.likeness(a, none) == 0


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_against_a_plain_loop(spark, monkeypatch, block):
    rnd = random.Random(4)
    rows = [(i * 3, _text(rnd, rnd.randrange(0, 90)), "en", "a", 0, 1, "x", 2) for i in range(50)]
    got = {r["doc_id"]: r for r in phrases.fingerprint_documents(spark.createDataFrame(rows, DOC_SCHEMA).repartition(6)).collect()}
    assert len(got) == 50
    for i, r in enumerate(rows):
        new = phrases.edited(r[1], rows[(i + 1) % 50][1])
        own, changed, following = phrases.signatures([x.encode() for x in (r[1], new, rows[(i + 1) % 50][1])])
        want = (len(r[1]), hashlib.sha256(new.encode()).hexdigest(), phrases.to_hex(own), phrases.to_hex(changed))
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"]) == want
        assert g["near_edited"] == phrases.likeness(own, changed) and g["near_next"] == phrases.likeness(own, following)


def test_awkward_rows(spark):
    got = phrases.fingerprint_documents(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["fingerprint"] == "" and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert phrases.fingerprint_documents(empty(spark)).count() == 0
    one = phrases.fingerprint_documents(awkward(spark).filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
