"""Functions of the regex module that find a pattern's compiled form in a cache of their own."""

from __future__ import annotations

from functools import cache

import regex

compiled = cache(regex.compile)


def match(pattern: str, s: str, flags: int = 0):
    return compiled(pattern, flags).match(s)


def fullmatch(pattern: str, s: str, flags: int = 0):
    return compiled(pattern, flags).fullmatch(s)


def search(pattern: str, s: str, flags: int = 0):
    return compiled(pattern, flags).search(s)


def findall(pattern: str, s: str, flags: int = 0):
    return compiled(pattern, flags).findall(s)


def sub(pattern: str, by: str, s: str, flags: int = 0):
    return compiled(pattern, flags).sub(by, s)


def split(pattern: str, s: str, maxsplit: int = 0):
    return compiled(pattern).split(s, maxsplit=maxsplit)
