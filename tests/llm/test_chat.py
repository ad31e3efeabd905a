import hashlib

import pytest

from larkspur.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\-", "<\\-s>", "a\\\\n", "<<SYS>>x<</SYS>>", "[[INST]]", "<</s>", "<|reply|><|end|>", "", "é\n漢", "<|role|>user\n"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible_and_hides_controls(text):
    out = chat.escape(text, chat.INST)
    assert chat.unescape(out) == text and not any(c in out for c in chat.INST.controls)
    for role in ("user", "assistant", "system", "tool\n\\x", "", None):
        parts = [p for p, _ in chat.segments(role, text, chat.INST)]
        assert chat.read_back(parts, chat.INST) == (role or "", text)


def test_table(frame):
    rows = [(c, t, ("user", "assistant")[t % 2], NASTY[(c + t) % len(NASTY)]) for c in range(12) for t in range(2 + c % 4)]
    rows += [(50, 0, "assistant", "first"), (51, 0, "user", None), (51, 1, None, "x"), (52, 0, "system", "s"), (52, 1, "user", "u"), (52, 2, "assistant", "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (53, 0, "user", "u"), (53, 0, "user", "u"), (54, None, "user", "first"), (54, 0, "assistant", "then"), (55, 0, "user", "y" * 300_000)]
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(frame(rows, SCHEMA).repartition(3))).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        whole = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(p) for _, _, role, text in own for p, _ in chat.segments(role, text, chat.INST))
        roles = [x[2] for x in own]
        ok = roles[-1] == "assistant" and all(b in chat.INST.follows.get(a, ()) for a, b in zip(["", *roles], roles, strict=False))
        assert r["valid"] == ok, roles
    assert chat.chat_digests(chat.format_chats(frame([], SCHEMA))).collect() == []
