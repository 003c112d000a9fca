"""A worker's encoder keeps the words of many texts, so that they are merged once."""

import pyarrow as pa

from tramlines.llm import textops, token_store, tokens


def test_words_of_many_texts_are_merged_once(monkeypatch):
    calls = []

    class Context:
        get = classmethod(lambda cls: cls())
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    def watched(*args):
        e = tokens.Encoder(*args)
        model = e.model
        e.model = type("Counted", (), {"tokenize": staticmethod(lambda text: calls.append(text) or model.tokenize(text))})
        return e

    monkeypatch.setattr(token_store, "TaskContext", Context)
    monkeypatch.setattr(token_store, "encoder", watched)
    texts = ["a " + " ".join(f"{chr(97 + i % 26)}{i}" for i in range(at, at + 5000)) for at in range(0, 450_000, 5000)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    marks = []

    def twice():
        for _ in range(2):
            marks.append(len(calls))
            yield batch

    first, second = token_store._encode(textops.tokenizer_path(), 0)(twice())
    assert marks[1] > 0 and len(calls) == marks[1]
    assert first.column(4).equals(second.column(4)) and second.column(2)[0].as_py() == len(first.column(4).values)
