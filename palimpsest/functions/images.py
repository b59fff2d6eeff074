"""Array kernels on stacks of small square or oblong drawings (numpy, vectorised over the stack)."""

from __future__ import annotations

import numpy as np


def dihedral_orders(height: int, width: int) -> np.ndarray:
    """Index permutations (8, height*width): quarter turns k=0..3, each followed by its mirror image.

    ``flat[order]`` is the turned drawing. For oblong drawings the odd quarter turns swap the sides.
    """
    grid = np.arange(height * width).reshape(height, width)
    out = []
    for k in range(4):
        turned = np.rot90(grid, k)
        out += [turned.reshape(-1), turned[:, ::-1].reshape(-1)]
    return np.stack(out)


def same_shape_orders(height: int, width: int) -> np.ndarray:
    """The turns that keep the shape: all eight for a square, four for an oblong."""
    orders = dihedral_orders(height, width)
    return orders if height == width else orders[[0, 1, 4, 5]]


def upright(pixels: np.ndarray, height: int, width: int) -> tuple[np.ndarray, int, int]:
    """Lay a stack of drawings (n, h*w) on the longer side, so that turned twins share a shape."""
    if height <= width:
        return pixels, height, width
    turned = np.rot90(pixels.reshape(-1, height, width), axes=(1, 2))
    return turned.reshape(len(pixels), -1), width, height


def centred(pixels: np.ndarray) -> np.ndarray:
    """Each drawing less its own mean, at unit length (float32)."""
    c = pixels.astype(np.float32)
    c = c - c.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return c / np.maximum(norm, 1e-12)


def orbits(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Orbit number of every pixel under the turns, and the orbits' sizes."""
    lead = same_shape_orders(height, width).min(axis=0)
    _, number, size = np.unique(lead, return_inverse=True, return_counts=True)
    return number, size


def turn_invariants(unit: np.ndarray, height: int, width: int) -> np.ndarray:
    """Two numbers for every orbit that no turn or mirroring changes: scaled mean and length.

    The map is 1-Lipschitz in each half, so drawings that agree in some orientation stay close.
    """
    number, size = orbits(height, width)
    member = np.zeros((height * width, len(size)), np.float32)
    member[np.arange(height * width), number] = 1
    mean = (unit @ member) / np.sqrt(size, dtype=np.float32)
    length = np.sqrt(np.maximum((unit * unit) @ member, 0))
    return np.hstack([mean, length]).astype(np.float32)


def best_turned_cosine(a: np.ndarray, b: np.ndarray, height: int, width: int) -> np.ndarray:
    """Largest cosine over the turns, pairwise for two stacks of centred unit drawings.

    Single precision tells which turns can be the best (its error is far below the margin), double precision gives their cosines.
    """
    orders = same_shape_orders(height, width)
    a, b = np.ascontiguousarray(a, np.float32), np.ascontiguousarray(b, np.float32)
    rough = np.stack([np.einsum("ij,ij->i", np.take(a, order, axis=1), b) for order in orders])
    near = rough >= rough.max(axis=0, initial=-2.0) - 1e-4
    best = np.full(len(a), -1.0)
    for order, rows in zip(orders, near):
        r = np.flatnonzero(rows)
        if len(r):
            best[r] = np.maximum(best[r], np.einsum("ij,ij->i", np.take(a[r].astype(np.float64), order, axis=1), b[r].astype(np.float64)))
    return best


def turn_free_hash(pixels: np.ndarray, height: int, width: int, block: int = 2_048) -> np.ndarray:
    """64-bit hash (int64) that is the same for all turned and mirrored versions of a drawing.

    Weighted sums modulo 2**64. The weights are cut into pieces of 16 bits, whose products with pixels add up exactly in double
    precision, so that one matrix product serves all turns.
    """
    orders = same_shape_orders(height, width)
    weight = np.random.default_rng(20240229).integers(1, 2**63, height * width, dtype=np.uint64)
    turned = np.empty((len(orders), len(weight)), np.uint64)
    for k, order in enumerate(orders):
        turned[k, order] = weight
    shift = np.arange(0, 64, 16, dtype=np.uint64)
    pieces = ((turned[:, None] >> shift[:, None]) & np.uint64(0xFFFF)).astype(np.float64).reshape(-1, len(weight)).T
    out = np.empty(len(pixels), np.uint64)
    for lo in range(0, len(pixels), block):
        sums = (pixels[lo : lo + block].astype(np.float64) @ pieces).astype(np.int64).view(np.uint64).reshape(-1, len(orders), len(shift))
        out[lo : lo + block] = (sums << shift).sum(axis=2, dtype=np.uint64).min(axis=1)
    return out.view(np.int64)


def cosine_basis(n: int) -> np.ndarray:
    """Orthonormal basis of the discrete cosine transform, frequencies by rows."""
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    basis = np.cos(np.pi * (x + 0.5) * k / n) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis.astype(np.float32)


def low_frequencies(unit: np.ndarray, height: int, width: int, keep: int = 10) -> np.ndarray:
    """The ``keep`` x ``keep`` lowest cosine frequencies of each drawing at unit length, (n, keep * keep).

    Drawings narrower than ``keep`` fill the rest with zeros. Turning or mirroring a drawing only swaps
    the two frequencies or the signs of the odd ones (see ``turned_frequencies``).
    """
    kh, kw = min(keep, height), min(keep, width)
    grid = unit.reshape(-1, height, width)
    rows = cosine_basis(height)[:kh] @ grid
    low = rows @ cosine_basis(width)[:kw].T
    out = np.zeros((len(unit), keep, keep), np.float32)
    out[:, :kh, :kw] = low
    out = out.reshape(len(unit), -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def turned_frequencies(low: np.ndarray, keep: int, square: bool = True) -> list[np.ndarray]:
    """The versions of ``low`` for all turns and mirrorings that keep the shape."""
    sign = (-1.0) ** np.arange(keep, dtype=np.float32)
    grid = low.reshape(-1, keep, keep)
    out = []
    for g in (grid, grid.transpose(0, 2, 1)) if square else (grid,):
        for a in (None, sign):
            for b in (None, sign):
                v = g
                if a is not None:
                    v = v * a[None, :, None]
                if b is not None:
                    v = v * b[None, None, :]
                out.append(np.ascontiguousarray(v.reshape(len(low), -1), dtype=np.float32))
    return out
