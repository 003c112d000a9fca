"""New words go to the tokenizer together and come back apart."""

from tramlines.llm import textops, tokens


def test_new_words_of_a_text_are_merged_together():
    e, calls = tokens.Encoder(textops.tokenizer_path()), []
    model = e.model

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return model.tokenize(text)

    e.model = Counted()
    text = "Start " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{mark}" for i in range(100) for mark in ("", ",", "é", "ó.", "'s", "ĠÂ", "7x", "日", "a\nb"))
    want = e.whole.encode(text, add_special_tokens=False).ids
    assert e.joins and e.encode(text) == b"".join(i.to_bytes(4, "little") for i in want)
    assert len(calls) < 600  # 300 words in three ways are two pieces or more when they go alone
    calls.clear()
    assert e.encode(text) == b"".join(i.to_bytes(4, "little") for i in want) and not calls
