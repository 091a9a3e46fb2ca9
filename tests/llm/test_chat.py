import hashlib
import random

import pytest
from hypothesis import given, strategies as st

from colsieve.llm import chat
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, path string, stream string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\e", "<", "/s>", " [/INST] ", "é🙂", "\n", "word "]


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    formatted = "".join(chat.render(r, t)[0] for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)


@given(st.lists(st.tuples(*[st.lists(st.sampled_from(BITS) | st.text(max_size=3), max_size=6).map("".join)] * 2), max_size=4))
def test_template_is_reversible(turns):
    formatted = "".join(chat.render(r, t)[0] for r, t in turns)
    assert chat.parse(formatted) == turns
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)
    assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def plain(rows):
    """Digests of every conversation of (conv_id, turn, role, text) rows, ordered as documented."""
    by_id = {}
    for i, n, r, t in rows:
        by_id.setdefault(i, []).append((n is not None, n or 0, r or "", t or ""))
    return {i: expected([(r, t) for *_, r, t in sorted(x)]) for i, x in by_id.items()}


def formatted(spark, rows, most=chat.PACK_CHARS):
    packed, known = chat.format_conversations(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), most)
    packed = packed.cache()
    return packed, {r[0]: tuple(r)[1:] for r in known.join(chat.read_back(packed), "path").drop("path").collect()}


def test_query_equals_plain_formatting(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    found = {r.conv_id: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in chat.op2_chat(spark, SF_SMALL).collect()}
    assert found == plain([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


@pytest.mark.parametrize("most", [chat.PACK_CHARS, 200])
def test_shared_turns_are_emitted_once(spark, most):
    """A hot first turn, equal conversations, one that begins another; small packs must hold them all, too."""
    draw = random.Random(3)
    rows = []
    for i in range(60):
        first = "hello" if i % 3 else f"first {i}"
        rows += [(i, 0, "user", first), (i, 1, "assistant", f"reply {draw.randrange(5)}")]
        rows += [(i, n, "user", f"more {draw.randrange(4)}") for n in range(2, 2 + i % 4)]
    rows += [(100 + i, 0, "user", "hello") for i in range(40)]
    packed, found = formatted(spark, rows, most)
    assert found == plain(rows)
    nodes, turns = set(), {}
    for i, n, r, t in sorted(rows):
        turns.setdefault(i, []).append((r, t))
        nodes.add(tuple(turns[i]))
    segments = sum(len(r.segments) for r in packed.collect())
    assert segments == len(nodes) if most == chat.PACK_CHARS else segments > len(nodes)
    assert all(len(r.stream) == sum(s.length for s in r.segments) for r in packed.collect())
    if most == 200:
        assert packed.count() > 30


def test_positions_and_attention(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c"), (2, 2, "user", "d")]
    packed, _ = formatted(spark, rows)
    (row,) = packed.collect()
    s = row.segments
    assert [x.parent for x in s] == [-1, 0, 0, 2]
    assert [x.position for x in s] == [0, s[0].length, s[0].length, s[0].length + s[2].length]
    assert [[(a.first, a.end) for a in x.attends] for x in s] == [[], [(0, s[1].first)], [(0, s[1].first)], [(0, s[1].first), (s[2].first, s[3].first)]]
    assert [row.stream[x.loss_first : x.loss_end] for x in s] == ["", "b", "c", ""]


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (1, None, "system", "first"), (2, 0, "assistant", "x" * 300_000)]
    rows += [(2, 1, "user", "same")] * 2 + [(None, 0, "user", "lost"), (None, 1, "assistant", "kept"), (3, 0, "Assistant", "other role")]
    rows += [(4, n, "user", "many") for n in range(2000)]
    assert formatted(spark, rows)[1] == plain(rows)


def test_empty_table(spark):
    packed, found = formatted(spark, [])
    assert packed.count() == 0 and found == {}
