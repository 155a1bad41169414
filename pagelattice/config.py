"""Parameters from the command line: ``key=value`` pairs, files of lines, and overrides of defaults."""

from __future__ import annotations

import argparse
import logging


def truth(text: str) -> bool:
    """true, t, yes, y and 1 are true, false, f, no, n and 0 false; anything else is refused."""
    word = text.strip().lower()
    if word in ("true", "t", "yes", "y", "1"):
        return True
    if word in ("false", "f", "no", "n", "0"):
        return False
    raise ValueError(f"no truth value: {text!r}")


def typed(text: str):
    """A value by its look: boolean, integer, number, list in brackets, or the text itself."""
    word = text.strip()
    if word.startswith("[") and word.endswith("]"):
        return [typed(x) for x in word[1:-1].split(",") if x.strip()]
    if word.lower() in ("true", "false"):
        return truth(word)
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            continue
    return word


class Pairs(argparse.Action):
    """``--x a=1 b=[2,3]`` as a dict; repeated options add up."""

    def __call__(self, parser, namespace, values, option_string=None):
        got = dict(getattr(namespace, self.dest) or {})
        for v in values if isinstance(values, list) else [values]:
            key, sign, text = v.partition("=")
            if not sign:
                parser.error(f"no key=value: {v}")
            got[key.strip()] = typed(text)
        setattr(namespace, self.dest, got)


class LineParser(argparse.ArgumentParser):
    """``@file`` stands for the file's arguments, any number a line; ``#`` begins a comment."""

    def __init__(self, **options):
        super().__init__(fromfile_prefix_chars="@", **options)

    def convert_arg_line_to_args(self, line: str) -> list[str]:
        return line.split("#", 1)[0].split()


def overridden(defaults: dict, given: dict, name: str = "parameters") -> dict:
    """defaults with the given values; unknown keys are reported and left out."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        logging.getLogger(__name__).warning("%s: unknown keys %s", name, ", ".join(unknown))
    return defaults | {k: v for k, v in given.items() if k in defaults}
