"""Array expressions that stay linear (or n log n) per row, as SQL text over higher-order functions.

Text, because nested lambdas built call by call through the Python gateway take longer to build than a small
table takes to process.
"""

from __future__ import annotations


def once(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once per row under ``name``, however often ``body`` names it (also in lambdas)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, combine: str) -> str:
    """The running result of an associative function over an array: ``combine`` of ``a`` and ``b`` (a running sum, a
    running maximum).

    By doubling: after step k an entry covers the 2**k entries up to it, so n entries take log2(n) linear passes and
    none copies the array per entry as a fold with an array as its state would.
    """
    entry = once("get(m, i - w)", "a", combine)
    step = once("cast(pow(2, k) as int)", "w", f"transform(m, (b, i) -> if(i >= w, {entry}, b))")
    steps = "sequence(0, cast(ceil(log2(size(run_of))) as int) - 1)"
    return once(values, "run_of", f"if(size(run_of) <= 1, run_of, aggregate({steps}, run_of, (m, k) -> {step}))")
