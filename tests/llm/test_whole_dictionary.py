"""The dictionary's words are those that the most texts of the whole corpus have."""

from tests.llm.texts import frame

from skyloom.llm import secrets


def test_every_text_is_counted(spark, monkeypatch):
    monkeypatch.setattr(secrets, "WORDS", 1)
    # More texts than any bounded sample held; the word of the last ones wins by one text.
    docs = [(i, "early words here" if i < 1500 else "later thing") for i in range(3001)]
    words = secrets.dictionary_of(frame(spark, docs)).split("\n")
    assert words[0] == "later" and words[1:] == secrets.IDENTIFIERS
    monkeypatch.setattr(secrets, "HELD", 1)
    assert secrets.dictionary_of(frame(spark, docs)).split("\n") == words
    assert secrets.dictionary_of(frame(spark, [])).split("\n") == secrets.IDENTIFIERS
