"""Small k x k algebra on the driver (numpy); never data-sized."""

from __future__ import annotations

import numpy as np


class RankDeficient(ValueError):
    pass


def sym_inv(a: np.ndarray, names: list[str] | None = None, tol: float = 1e-10) -> np.ndarray:
    """Inverse of a symmetric positive (semi)definite matrix via scaled Cholesky.

    Scaling by the diagonal makes the rank check unit-free; a dependent column
    raises :class:`RankDeficient` naming it.
    """
    a = np.asarray(a, dtype=float)
    k = a.shape[0]
    if k == 0:
        return a.copy()
    d = np.sqrt(np.clip(np.diag(a), 0, None))
    bad = [i for i in range(k) if d[i] == 0]
    if bad:
        raise RankDeficient(f"constant or all-zero column(s): {_nm(names, bad)}")
    s = a / np.outer(d, d)
    piv = pivoted_dependents(s, tol)
    if piv:
        raise RankDeficient(f"linearly dependent column(s): {_nm(names, piv)}")
    c = np.linalg.cholesky(s)
    ci = np.linalg.inv(c)
    inv_s = ci.T @ ci
    return inv_s / np.outer(d, d)


def pivoted_dependents(s: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Columns that are (near) linear combinations of earlier ones."""
    k = s.shape[0]
    dep = []
    keep: list[int] = []
    for j in range(k):
        idx = keep + [j]
        sub = s[np.ix_(idx, idx)]
        if keep:
            a = s[np.ix_(keep, keep)]
            b = s[np.ix_(keep, [j])]
            try:
                resid = sub[-1, -1] - (b.T @ np.linalg.solve(a, b))[0, 0]
            except np.linalg.LinAlgError:
                resid = 0.0
        else:
            resid = sub[0, 0]
        if resid <= tol * max(1.0, s[j, j]):
            dep.append(j)
        else:
            keep.append(j)
    return dep


def _nm(names, idx):
    if names is None:
        return [f"x{i}" for i in idx]
    return [names[i] for i in idx]


def solve_psd(a: np.ndarray, b: np.ndarray, names=None) -> np.ndarray:
    return sym_inv(a, names) @ b
