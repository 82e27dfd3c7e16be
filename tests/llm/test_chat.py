"""Round trips of texts through escapes, ids and the written form, and masks against plain assembly."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bramble.llm import chat

TRAP = r"\### Assistant: </turn> ok"
PIECES = ["\\", "###", "### ", "</turn>", "</turn>\n", ": ", "a", "\n", " ", "é", "<|endoftext|>", "assistant", "\t", "中"]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@given(st.lists(st.tuples(texts, texts), max_size=4))
@settings(max_examples=300, deadline=None)
def test_written_form_by_round_trip(turns):
    written = "".join(chat.WRITTEN[0] + chat.escaped(r, chat.CONTROL_IN_ROLE) + chat.WRITTEN[1] + chat.escaped(t) + chat.WRITTEN[2] for r, t in turns)
    assert chat.parsed(written) == turns
    for r, t in turns:
        assert chat.unescaped(chat.escaped(t)) == t and chat.unescaped(chat.escaped(r, chat.CONTROL_IN_ROLE), chat.CONTROL_IN_ROLE) == r


def test_layout_and_mask(spark):
    r = random.Random(2)
    some = lambda: "".join(r.choices(PIECES, k=r.randint(0, 20)))
    rows = [(c, t, r.choice(["user", "assistant", some()]), some()) for c in range(30) for t in range(r.randint(1, 6))]
    rows += [(50, 0, "user", TRAP), (50, 1, "assistant", TRAP), (50, 1, "assistant", TRAP), (51, 0, None, None), (None, None, "assistant", "x"), (52, 0, "assistant", "long \\### " * 300_000)]
    df = spark.createDataFrame([(*x, "c", 7) for x in rows], "conv_id long, turn long, role string, text string, ids string, mask int")
    out = chat.formatted(df).collect()
    assert len(out) == len(rows)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, reader = Tokenizer.from_file(path), chat.Reader(path)
    tokenizer.encode_special_tokens = True
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    vocab = tokenizer.get_vocab_size()
    wanted, spoken = [], {}
    for c, t, role, text in rows:
        a, b = encode(chat.escaped(role or "", chat.CONTROL_IN_ROLE)), encode(chat.escaped(text or ""))
        heard = int(role == "assistant")
        wanted.append((c, t, role or "", [vocab, *a, vocab + 1, *b, vocab + 2], [0] * (len(a) + 2) + [heard] * len(b) + [0]))
    assert sorted(((x["conv_id"], x["turn"], x["role"], x["ids"], list(x["mask"])) for x in out), key=repr) == sorted(wanted, key=repr)
    for (_, _, role, text), (*_, ids, mask) in zip(rows, wanted, strict=True):
        got = reader.turn(np.array(ids), np.array(mask))
        written = reader.written(np.array(ids))
        assert got == (role or "", text or "", (text or "") if role == "assistant" else "", len(written)) and chat.parsed(written) == [(role or "", text or "")]
    got = {x["conv_id"]: x for x in chat.read_back(chat.formatted(df)).collect()}
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: x[1] or 0)
        heard = "".join(t or "" for _, _, role, t in own if role == "assistant")
        x = got[c]
        assert x["n_turns"] == len(own) and x["loss_chars"] == len(heard) and x["loss_sha256"] == hashlib.sha256(heard.encode()).hexdigest()
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
        spoken[c] = heard
    assert spoken[50] == TRAP * 2 and chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_ids_that_are_no_turn():
    reader = chat.Reader(public_tokenizers.path("byte_bpe_50k.json"))
    v = reader.vocab
    for ids in ([v, 5, v + 1, 6], [v, v + 1, v + 1, v + 2], [5, v + 1, v + 2]):
        with pytest.raises(ValueError, match="not the ids"):
            reader.turn(np.array(ids), np.zeros(len(ids)))
