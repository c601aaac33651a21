"""Models that once left out a part of their training texts."""

from quarry.llm import toxicity


def test_ordinary_dictionary_learns_from_all_texts(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_trained", lambda size, samples: seen.append(samples) or b"")
    texts = ["plain words of a long text " * 4000] * 60 + ["the last text " * 30]
    toxicity.dictionaries(["bad snarkwort here"] * 8, texts)
    want = [w for text in texts for w in toxicity.windows(text, 256)]
    assert len(want) > 20_000 and seen[0] == want
