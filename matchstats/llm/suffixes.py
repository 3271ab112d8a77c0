"""Suffix arrays of many short texts at once, by linear grouping of suffixes, with numpy.

The texts stand one after another, each closed by a separator; separators are smaller than all letters and differ from each
other, so no comparison passes one.  First the suffixes are grouped by their Lyndon prefixes, the longest Lyndon words that
start them.  A Lyndon prefix is a letter followed by the prefixes of the suffix's children: those whose previous smaller
suffix it is.  So groups are processed from the highest letter down; each processed group is found by its previous-smaller
pointers and moves its parents to a higher part of their own group.  A group's number is its first place in the suffix
array and only ever rises.  Then each group is put in order by the places of its members' next smaller suffixes, which
lie in lower groups; nothing is renamed and no suffix is sorted by its text.
"""

from __future__ import annotations

import numpy as np


def _split(group: np.ndarray, size: np.ndarray, rows: np.ndarray, key: np.ndarray) -> bool:
    """Moves the rows to the upper end of their groups, in the order of key; whether any group was really divided."""
    own = group[rows]
    order = np.argsort(own.astype(np.int64) * (len(group) + 1) + key, kind="stable")
    rows, own, key = rows[order], own[order], key[order]
    new_group = np.concatenate([[True], own[1:] != own[:-1]])
    new = new_group | np.concatenate([[True], key[1:] != key[:-1]])
    start, run = np.flatnonzero(new_group), np.flatnonzero(new)
    moved, length = np.diff(np.append(start, len(rows))), np.diff(np.append(run, len(rows)))
    before = size[own[start]]
    divided = len(run) > len(start) or bool((moved < before).any())
    which = np.cumsum(new_group)[run] - 1  # the group of each run
    first = own[run] + before[which] - (moved[which] - (run - start[which]))
    size[own[start]] = before - moved
    size[first] = length
    group[rows] = np.repeat(first, length)
    return divided


def _lower(group: np.ndarray, prv: np.ndarray, low: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The nearest place before each row with a lower group.

    prv points to the nearest place whose group is not higher; it can only move on as groups rise.  Those of the same group
    may still become lower, so they are passed in low alone.
    """
    at, todo = prv[rows], np.arange(len(rows))
    while len(todo):
        todo = todo[group[at[todo]] > group[rows[todo]]]
        at[todo] = prv[at[todo]]
    prv[rows] = low[rows] = at
    todo = rows
    while len(todo):
        todo = todo[group[low[todo]] == group[todo]]
        low[todo] = low[low[todo]]
    return low[rows]


def _within_letter(s: np.ndarray, group: np.ndarray, size: np.ndarray, prv: np.ndarray, low: np.ndarray, rows: np.ndarray, child: np.ndarray, busy: np.ndarray) -> None:
    """Divides the groups of one letter by children of the same letter.

    Groups are divided by their first open children until nothing moves; then children whose groups can't be divided any
    more are passed, and the next ones count.  A member without a child belongs below one with a child, as any child it
    may still get is lower.
    """
    letter, open_ = s[rows[0]], rows
    while True:
        _lower(group, prv, low, open_[group[prv[open_]] >= group[open_]])
        near = prv[open_]
        fixed = group[near] < group[open_]  # no other parent from now on
        low[open_[fixed]] = near[fixed]
        up = low[open_]
        useful = (s[up] == letter) & (size[group[up]] > 1)
        open_, up, useful = open_[stay := ~fixed | useful], up[stay], useful[stay]
        kids, up = open_[useful], up[useful]
        if not len(kids):
            return
        child[up[::-1]] = kids[::-1]  # of several the first
        first = child[up] == kids
        heads, kids = up[first], kids[first]
        if not _split(group, size, heads, group[kids]):
            busy[group[heads]] = True  # groups that still have children to look at
            done = ~busy[group[kids]]
            busy[group[heads]] = False
            if not done.any():
                return
            child[kids[done]] = -2  # passed: a child of a passed suffix has been looked at before
            open_ = open_[child[open_] != -2]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start[i], ..., start[i] + length[i] - 1 for all i, one after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return start, np.diff(np.append(start, len(values)))


def lyndon_groups(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, size): the group of each suffix, numbered by its first place, and the sizes of groups by that number."""
    n = len(s)
    order = np.argsort(s.astype(np.uint16), kind="stable").astype(np.int32)
    first, length = _runs(s[order])
    letters, ends = s[order[first]], first + length
    group, size = np.zeros(n, np.int32), np.zeros(n + 1, np.int32)
    prv, child, busy = np.arange(-1, n - 1, dtype=np.int32), np.full(n, -1, np.int32), np.zeros(n + 1, bool)
    low = prv.copy()
    group[order] = np.repeat(first, length)
    size[first] = length
    group[order[: ends[0]]], size[: ends[0]] = np.arange(ends[0]), 1  # the separators
    for k in range(len(letters) - 1, 0, -1):
        rows = order[first[k] : ends[k]]
        _within_letter(s, group, size, prv, low, rows, child, busy)
        up = prv[rows] = _lower(group, prv, low, rows)
        keep = (s[up] != letters[k]) & (s[up] > 0)
        keep[keep] = size[group[up[keep]]] > 1
        kids, up = rows[keep], up[keep]
        by = np.argsort(up, kind="stable")
        kids, up = kids[by], up[by]
        new, count = _runs(up)
        nth = 0
        while len(new):  # all parents' first children, then all second ones, ...
            own = new + nth
            more = size[group[up[own]]] > 1
            own, new, count = own[more], new[more], count[more]
            if len(own):
                _split(group, size, up[own], group[kids[own]])
            nth += 1
            more = count > nth
            new, count = new[more], count[more]
    return group, size


def suffix_places(s: np.ndarray) -> np.ndarray:
    """The place of each suffix in the suffix array.  s has 0 for separators, its first and last value among them."""
    group, size = lyndon_groups(s)
    n = len(s)
    # The next smaller suffix: the nearest later place whose group is not higher.
    after, todo = np.arange(1, n + 1, dtype=np.int32), np.flatnonzero(s)
    while len(todo):
        todo = todo[group[after[todo]] > group[todo]]
        after[todo] = after[after[todo]]
    rows = np.flatnonzero(size[group] > 1).astype(np.int32)
    # Repetitions: a suffix followed by one of its own group stands above all that are not.
    again = rows[group[after[rows]] == group[rows]]
    if len(again):
        level = np.zeros(n, np.int32)
        for i in again[::-1].tolist():
            level[i] = level[after[i]] + 1
        deep = again[size[group[again]] > 1]
        _split(group, size, deep, level[deep])
        rows = rows[size[group[rows]] > 1]
    place = np.where(size[group] == 1, group, -1).astype(np.int32)
    # A group waits until all places that its members are ordered by are known.
    rows = rows[np.argsort(group[rows])]
    start, length = _runs(group[rows])
    at, waits = np.zeros(n, np.int32), np.zeros(n, np.int32)  # by group: its first row, the members that wait
    at[group[rows[start]]] = start
    unknown = place[after[rows]] < 0
    waits[group[rows[start]]] = np.add.reduceat(unknown, start, dtype=np.int32) if len(rows) else 0
    dependent = rows[unknown]
    dependent = dependent[np.argsort(after[dependent])]
    of, count = _runs(after[dependent])
    first, many = np.zeros(n, np.int32), np.zeros(n, np.int32)  # by suffix: those that wait for its place
    first[after[dependent[of]]], many[after[dependent[of]]] = of, count
    ready = group[rows[start]]
    ready = ready[waits[ready] == 0]
    while len(ready):
        own = rows[_ranges(at[ready], size[ready])]
        own = own[np.argsort(group[own].astype(np.int64) * (n + 1) + place[after[own]])]
        place[own] = group[own] + _ranges(np.zeros(len(ready), np.int64), size[np.sort(ready)])
        told = np.sort(group[dependent[_ranges(first[own], many[own])]])
        start, length = _runs(told)
        told = told[start]
        waits[told] -= length
        ready = told[waits[told] == 0]
    return place
