"""Whole jobs where a cap used to drop a part."""

import json
import random

from siftgraph.llm import page_wrappers as W


def read(html):
    return W.fold(W.read_page(html)[0])


def test_wrapper_takes_in_every_part_of_every_page():
    # six nodes hold the first page only; the words of the others decide which container has the text
    said = [[f"w{rng.randrange(99)} " * 6 for _ in range(4)] for rng in map(random.Random, range(3))]
    page = lambda k: "<div class=a><p>few words</p></div><div class=b>" + "".join(f"<h{i}>{s}</h{i}>" for i, s in enumerate(said[k], k + 1)) + "</div>"
    wrapper = read("<div class=a><p>some other words</p></div>")
    for k in range(3):
        wrapper = W.unify(wrapper, read(page(k)), 6)
    assert sum(x.words for x in W._slots(wrapper)) == 3 + sum(x.words for k in range(3) for x in W._slots(read(page(k))))
    nodes = json.dumps(W.dumped(wrapper))
    for k in range(3):
        assert W.main_text(page(k), nodes) == " ".join(" ".join(said[k]).split())


def test_alignment_in_halves_equals_alignment_at_once(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([W.Node(rng.choice("abcdefg")) for _ in range(rng.randrange(30))] for _ in range(2))
        a = [W.group([x, x], 1) if rng.random() < 0.2 else x for x in a]
        b = [W.group([x, x], 1) if rng.random() < 0.2 else x for x in b]
        whole = W.align(a, b)
        assert all(a[i].glue() == b[j].glue() for i, j in whole)
        assert whole == sorted(whole) == W.align(a, b, 2)
        with monkeypatch.context() as m:
            m.setattr(W, "CELLS", 3)
            assert W.align(a, b) == whole
