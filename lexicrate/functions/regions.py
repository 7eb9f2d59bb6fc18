"""Parts of words that the stemmers share."""

from __future__ import annotations


def region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part behind the first consonant after a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def longest(word: str, endings) -> str:
    """The longest of the endings that the word has, or nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def verb_region(word: str, vowels: str) -> int:
    """Where verb endings of Spanish, Italian and Portuguese may begin."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


def cut(word: str, ending: str, start: int) -> str:
    """The word without the ending, if the ending lies behind start."""
    if ending and word.endswith(ending) and len(word) - len(ending) >= start:
        return word[: -len(ending)]
    return word
