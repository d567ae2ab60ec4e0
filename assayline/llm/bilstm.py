"""A small bidirectional LSTM tagger in numpy: sequences of vectors in, a probability for each position out."""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def start(dim: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":
        w[f"x{d}"] = rng.standard_normal((dim, 4 * hidden)) / np.sqrt(dim)
        w[f"h{d}"] = rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)
        w[f"c{d}"] = np.zeros(4 * hidden)
        w[f"c{d}"][hidden : 2 * hidden] = 1.0  # forget gates start open
    w["o"] = rng.standard_normal((2 * hidden + dim, 1)) / np.sqrt(2 * hidden + dim)
    w["b"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: Weights, d: str) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over x (T, B, D); where mask is 0 the state stays."""
    steps, batch, _ = x.shape
    size = w[f"h{d}"].shape[0]
    h, c = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype)
    ahead = x @ w[f"x{d}"] + w[f"c{d}"]
    out, kept = np.zeros((steps, batch, size), x.dtype), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = ahead[t] + h @ w[f"h{d}"]
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        m = mask[t][:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        kept.append((t, h, c, i, f, o, g, tanh, m))
        c, h = m * new + (1 - m) * c, m * o * tanh + (1 - m) * h
        out[t] = h
    return out, kept


def forward(x: np.ndarray, mask: np.ndarray, w: Weights) -> tuple[np.ndarray, tuple]:
    """Probabilities (T, B)."""
    f, kf = _run(x, mask, w, "f")
    b, kb = _run(x, mask, w, "b")
    top = np.concatenate([f, b, x], axis=2)
    return _sigmoid((top @ w["o"])[:, :, 0] + w["b"][0]), (top, kf, kb)


def gradients(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Mean log loss over the masked positions, and its gradients."""
    p, (top, kf, kb) = forward(x, mask, w)
    n = max(mask.sum(), 1)
    loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
    delta = ((p - y) * mask / n)[:, :, None]
    flat = lambda a: a.reshape(-1, a.shape[2])
    g: Weights = {"o": flat(top).T @ flat(delta), "b": np.array([delta.sum()])}
    back = delta * w["o"][:, 0]
    size = w["hf"].shape[0]
    for d, kept, dh_out in (("f", kf, back[:, :, :size]), ("b", kb, back[:, :, size : 2 * size])):
        dz_all = np.zeros((x.shape[0], x.shape[1], 4 * size), x.dtype)
        gh = np.zeros_like(w[f"h{d}"])
        dh, dc = np.zeros((x.shape[1], size), x.dtype), np.zeros((x.shape[1], size), x.dtype)
        for t, h, c, i, f, o, gg, tanh, m in reversed(kept):
            dh = dh + dh_out[t]
            live = m * dh
            dnew = m * dc + live * o * (1 - tanh**2)
            dz = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - gg**2)], axis=1)
            dz_all[t] = dz
            gh += h.T @ dz
            dh = (1 - m) * dh + dz @ w[f"h{d}"].T
            dc = (1 - m) * dc + dnew * f
        g[f"h{d}"] = gh
        g[f"x{d}"] = flat(x).T @ flat(dz_all)
        g[f"c{d}"] = dz_all.sum(axis=(0, 1))
    return loss, g


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(T, B, ...) with zeros after each row's end, and the mask (T, B)."""
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), *rows[0].shape[1:]), np.float32), np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


def train(rows: list[np.ndarray], labels: list[np.ndarray], hidden: int, epochs: int, rate: float, seed: int, steps: int = 0, batch: int = 32) -> Weights:
    """Adam over batches of sequences of similar length: so many epochs, and at least so many steps, ever smaller ones."""
    w = start(rows[0].shape[1], hidden, seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    order = np.argsort([len(r) for r in rows], kind="stable")
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    rng, step = np.random.default_rng(seed), 0
    total = max(epochs, -(-steps // len(groups))) * len(groups)
    for _ in range(total // len(groups)):
        for k in rng.permutation(len(groups)):
            x, mask = padded([rows[i] for i in groups[k]])
            y, _ = padded([labels[i] for i in groups[k]])
            _, g = gradients(x, y, mask, w)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            slower = rate * (1 - 0.95 * step / total)
            for name, v in g.items():
                v = v * min(1.0, 2.0 / (norm + 1e-9))
                m1[name] = 0.9 * m1[name] + 0.1 * v
                m2[name] = 0.99 * m2[name] + 0.01 * v * v
                w[name] = w[name] - slower * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)
    return w


def predict(rows: list[np.ndarray], w: Weights, positions: int = 4096) -> list[np.ndarray]:
    """Probabilities of each row's positions; rows of similar length run together, at most so many positions."""
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(rows[order[end]]) * (end - at + 1) <= positions:
            end += 1
        x, mask = padded([rows[i] for i in order[at:end]])
        p, _ = forward(x, mask, w)
        for k, i in enumerate(order[at:end]):
            out[i] = p[: len(rows[i]), k]
        at = end
    return out
