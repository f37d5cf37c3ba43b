from __future__ import annotations

from topoeval.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, body string, position int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def by_hand(rows):
    """Brute force: every passage against the own text of every earlier message of the conversation."""
    parsed = [(c, t, r, *Q.parse(x or "")) for c, t, r, x in rows]
    out = []
    for c, t, r, body, passages in parsed:
        best = None
        for depth, p in passages:
            h = Q.digest(p)
            if h is None:
                continue
            origin = min((u for d, u, _, b, _ in parsed if d == c and u is not None and h in Q.own_hashes(b)), default=None)
            if origin is not None and t is not None and origin < t:
                best = max(best or (-99, 0, 0), (-depth, len(p.split()), origin))
        before = max((u for d, u, _, _, _ in parsed if d == c and u is not None and t is not None and u < t), default=None)
        parent = best[2] if best else before
        link = "quote" if best else "sequence" if before is not None else "start"
        out.append((c, t, r, parent, link, len(passages), body))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "user", "How do I sort a list?\n\nIt is long."),
    (1, 1, "assistant", "Use sorted."),
    (1, 2, "user", "Thanks, another question:\nhow about maps?"),
    (1, 3, "assistant", "On Monday someone wrote:\n> How do I  SORT a list?\n\nAlso in place."),
    (1, 4, "user", ">> Use sorted.\n> Also in place.\nYes!"),
    (1, 5, "assistant", "> never said\nHm."),
    (1, 600, "assistant", "> Thanks, another question:\n> how about maps?\nAs pairs."),
    (2, 0, "user", "> Use sorted.\nquoting another conversation"),
    (2, 0, "user", "> Use sorted.\nquoting another conversation"),
    (2, None, "user", "no turn"),
    (None, 3, "user", "no conversation"),
    (3, 7, None, None),
    (3, 9, "user", ""),
    (5, 0, "user", "What now?"),
    (5, 1, "assistant", "Wait."),
    (5, 2, "user", "> Wait.\n>\n> On Monday someone wrote:\n>> What now?\nFine."),
    (4, 1, "user", "\n".join(f"> line {k}" for k in range(5000))),
]


def test_by_hand(spark):
    got = Q.link_conversations(table(spark, ROWS)).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.parent_turn, r.link, r.n_quotes, r.body) for r in got), key=str) == by_hand(ROWS)
    for conv in {r.conv_id for r in got}:
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == [*range(1, len(own) + 1)]
        turns = [-1 if r.turn is None else r.turn for r in own]
        assert turns == sorted(turns)
    parents = {r.turn: r.parent_turn for r in got if r.conv_id == 1}
    assert parents == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 4, 600: 2}
    # the line that introduces the inner quote is not part of the outer one
    assert {r.turn: (r.parent_turn, r.link) for r in got if r.conv_id == 5}[2] == (1, "quote")


def test_parse():
    body, passages = Q.parse("a\n> b\n> c\n>> d\n> e\nf")
    assert body == "a\nf" and passages == [(1, "b\nc"), (2, "d"), (1, "e")]
    assert Q.parse("plain > not a quote") == ("plain > not a quote", [])


def test_rendered_and_empty(spark):
    linked = Q.link_conversations(table(spark, ROWS))
    text = {(r.conv_id, r.position): r.text for r in Q.rendered(linked).collect()}
    assert text[1, 4] == "<|assistant|>\nAlso in place.\n" and text[3, 1] == "<||>\n\n"
    assert len(text) == len(ROWS)
    assert Q.link_conversations(table(spark, ROWS).limit(0)).count() == 0
