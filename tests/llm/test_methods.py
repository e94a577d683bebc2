"""Parts of the methods against plain versions: the network, and best fit."""

import random

import numpy as np
import pytest

from quillon.llm import langid, packing


def small_network():
    net = langid.Network(["a", "b", "c"], seed=2)
    rng = np.random.default_rng(3)
    return net, rng.integers(0, 257, (5, langid.WINDOW)).astype(np.int16), np.array([0, 1, 2, 1, 0])


def plain_features(net, window):
    """Filters slid over embedded bytes one by one, and the greatest response of each, at least 0."""
    e = net.w["embed"][window]
    out = []
    for k in langid.WIDTHS:
        for f in range(langid.FILTERS):
            weights = net.w[f"conv{k}"][:, f].reshape(k, langid.EMBED)
            out.append(max(0.0, max(float((e[i : i + k] * weights).sum()) for i in range(len(window) - k + 1))))
    return np.array(out)


def test_features():
    net, x, _ = small_network()
    assert np.allclose(net.features(x[:2]), [plain_features(net, w) for w in x[:2]], atol=1e-4)
    p = net.probabilities(x)
    z = net.features(x) @ net.w["out"] + net.w["bias"]
    assert np.allclose(p, np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), atol=1e-5)


def test_gradients():
    """As differences of the loss, in double precision."""
    net, x, y = small_network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    loss = lambda: -np.log(net.probabilities(x)[np.arange(len(y)), y]).mean()
    found = net.gradients(x, y)
    rng = random.Random(4)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.randrange(n) for n in w.shape)
            kept, h = w[at], 1e-6
            w[at] = kept + h
            up = loss()
            w[at] = kept - h
            down = loss()
            w[at] = kept
            assert found[name][at] == pytest.approx((up - down) / (2 * h), abs=2e-5), (name, at)


def test_windows_of_a_text():
    """A text's score is the mean over its windows by their bytes, the last one shorter."""
    import pyarrow as pa

    net, _, _ = small_network()
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(langid.WINDOW * 2 + 50))
    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text]), "held_out": pa.array([False])})
    (got,) = (r for b in langid.predict([batch], net) for r in b.to_pylist())
    total = np.zeros(3)
    for i in range(0, len(text), langid.WINDOW):
        piece = text[i : i + langid.WINDOW].encode()
        window = np.array([*piece, *[256] * (langid.WINDOW - len(piece))])
        z = plain_features(net, window) @ net.w["out"] + net.w["bias"]
        total += len(piece) * np.exp(z) / np.exp(z).sum()
    assert got["lang_pred"] == net.labels[total.argmax()] and got["score"] == pytest.approx(total.max() / len(text), abs=1e-4)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit(seed):
    """What the reduction leaves goes as best fit, longest first, would put it one by one."""
    rng = random.Random(seed)
    size = 64
    counts = {}
    for _ in range(rng.randint(1, 150)):
        n = rng.randint(1, rng.choice([10, 30, 64]))
        counts[n] = counts.get(n, 0) + 1
    sets, fixed = packing.plan(counts, size)
    left, n_fixed, rest = dict(counts), 0, []
    for chosen, n in sets:
        if n_fixed < fixed:
            n_fixed += n
            for x in chosen:
                left[x] -= n
        else:
            rest += [chosen] * n
    assert n_fixed == fixed and all(n >= 0 for n in left.values())
    rooms = []
    for x in sorted((x for x, n in left.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(size - x)
    assert sorted(size - sum(chosen) for chosen in rest) == sorted(rooms)
