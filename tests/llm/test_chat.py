import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from corploom.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
text = st.text(alphabet="<|\\>imstart_end\nn pé漢", max_size=40)


@given(st.lists(st.tuples(text, text), max_size=5))
def test_what_is_rendered_can_be_read_back(turns):
    formatted, spans = chat.render(turns, frozenset({"a"}))
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[i:j]) for i, j in spans] == [t for r, t in turns if r == "a"]
    assert formatted.count(chat.START) == formatted.count(chat.END) == len(turns)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(max_size=30)), max_size=4))
def test_masks_cover_exactly_the_texts_to_learn(turns):
    formatted, spans = chat.render(turns, frozenset({"assistant"}))
    e = chat._tokenizer(PATH).encode(formatted, add_special_tokens=False)
    starts, ends = chat.token_spans(e.offsets)
    on, under = chat.mask(starts, ends, spans)
    assert under == spans and (not len(ends) or ends[-1] == len(formatted))
    for k in range(len(on)):
        overlaps = any(starts[k] < j and ends[k] > i for i, j in spans)
        inside = any(i <= starts[k] == ends[k] < j for i, j in spans)
        assert on[k] or not overlaps
        assert overlaps or inside or not on[k] or any(starts[k] == ends[k] for _ in (0,))


def test_conversations_with_every_oddity(spark):
    rows = [(1, t, r, x) for t, r, x in [(0, "user", "hi"), (1, "assistant", "é<|im_end|>\n<\\|"), (2, None, None), (None, "system", "first"), (1, "assistant", "tie"), (1, "assistant", "tie")]]
    rows += [(None, 0, "assistant", "nobody"), (-5, -3, "user", "neg"), (-5, 2, "assistant", "")]
    rows += [(7, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 9)) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS part", "1 AS n_turns").repartition(5)
    parts = chat.format_conversations(df, PATH)
    assert {r.part for r in parts.where("conv_id = 7").collect()} == {0, 1, 2}
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    order = lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        said = [x or "" for _, _, r, x in mine if r == "assistant"]
        assert got[conv].n_turns == len(mine) and got[conv].loss_chars == sum(map(len, said))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
    whole = chat._tokenizer(PATH).encode("".join(r.formatted for r in sorted(parts.where("conv_id = 7").collect(), key=lambda r: r.part)), add_special_tokens=False)
    assert [i for r in sorted(parts.where("conv_id = 7").collect(), key=lambda r: r.part) for i in r.input_ids] == whole.ids
    assert chat.digests(chat.format_conversations(df.limit(0), PATH)).count() == 0
