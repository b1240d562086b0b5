"""The tokenizer's table of words stays small and gives the tokenizer's own ids."""

import public_tokenizers

from skyloom.llm import tokens
from skyloom.llm.tokens import WordEncoder


def test_ids_of_odd_words_and_of_a_small_table():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = WordEncoder(path, 60)
    odd = ["İstanbul Ȿƀ ƁƂɃ Ⱥb Straße ÉCOLE it's don't''ll a<|b <|endoftext|>x tab\tin\r\nline\x0bend", "", " ", "\n\n", "été naïve 北京 x²½ 12,5% ŉ ǅ", "a  b"]
    for k in range(30):
        texts = [*odd, " ".join(f"w{k}x{i}" for i in range(40)), "the same again the same again"]
        ids, n = e.encode(texts)
        want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
        assert len(e.codes) < 200 and len(e.parts) < 300
        # Words that come again are kept when the table is full.
        assert k == 0 or {"the", "same", "again"} <= known
        known = set(e.codes.often(e.most))


def test_words_met_again_are_not_learned_again():
    e = tokens.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{i}a{k}" for i in range(2000)) for k in range(60)]
    for t in texts:
        e.encode([t])
    learned = []
    e._learn = lambda: learned.append(len(e.codes.new))
    for t in texts[::7]:
        e.encode([t])
    assert not learned and len(e.codes) <= e.most
    tokens.forget()
    assert tokens.word_encoder(public_tokenizers.path("word_bpe_49k.json")) is not e
