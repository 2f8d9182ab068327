"""The base dictionary is trained on every window of the sample."""

import zstandard

from chartlake.llm import toxicity


def test_all_windows_train_the_base(monkeypatch):
    seen = []

    def taken(size, samples, **_):
        seen.append(samples)
        raise zstandard.ZstdError("only counted")

    monkeypatch.setattr(zstandard, "train_dictionary", taken)
    long = " ".join(f"w{i % 997}" for i in range(3000))
    texts = [f"{n} {long}" for n in range(400)]
    toxicity.train([(t, 0) for t in texts] + [("bad words", 1), ("bad words here", 1)])
    want = sum(len(toxicity.windows(t)) for t in texts[::2])
    assert want > 60_000 and len(seen[0]) == want
