"""Names of games and composers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page furniture that is no game name.
NOT_GAMES = ("mega drive", "sega cd", "32x", "games which use", "contents", "history", "usage", "source code", "external links", "references")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _collapse(c: Column) -> Column:
    return _strip(F.regexp_replace(c, r"\s+", " "))


def game_of_file(filename: Column) -> Column:
    """The part of a file name before '_-_', with spaces for underscores; a folder in front stays."""
    bare = F.replace(filename, F.lit(".opm"), F.lit(""))
    return F.coalesce(F.replace(F.substring_index(bare, "_-_", 1), F.lit("_"), F.lit(" ")), F.lit("Unknown"))


def clean_game(name: Column) -> Column:
    """A listed title without years and tags; null if too short or no title."""
    c = _strip(name)
    long_enough = F.length(c) >= 3
    c = F.regexp_replace(c, r"\s*\(\d{4}\)\s*", " ")
    for tag in (r"(?:un)?released", r"[^)]*test\s*drive[^)]*", r"[^)]*page\s*\d+[^)]*"):
        c = F.regexp_replace(c, rf"(?i)\s*\({tag}\)\s*", "")
    c = _collapse(c)
    furniture = reduce(or_, [F.lower(c).contains(x) for x in NOT_GAMES])
    return F.when(long_enough & (F.length(c) >= 3) & ~furniture, c)


def normal_game(name: Column) -> Column:
    """Without one trailing (...) and then one trailing [...]."""
    c = F.regexp_replace(_strip(name), r"\s*\([^)]*\)\s*$", "")
    c = F.regexp_replace(c, r"\s*\[[^\]]*\]\s*$", "")
    return F.nullif(_collapse(c), F.lit(""))


def normal_composer(name: Column) -> Column:
    """Without a leading title."""
    return F.nullif(_collapse(F.regexp_replace(_strip(name), r"(?i)^\s*(?:Mr\.|Ms\.|Dr\.)\s+", "")), F.lit(""))


def pack_title(title: Column) -> Column:
    """Without any (...) and from the first slash on; null if under three characters."""
    c = F.regexp_replace(_strip(title), r"\s*\([^)]+\)\s*", " ")
    c = _strip(F.regexp_replace(c, r"(?s)\s*/\s*.*$", ""))
    return F.when(F.length(c) >= 3, c)


def pair_key(game: Column, name: Column) -> Column:
    """One key for a game and a preset name, whatever their case and outer spaces."""
    return F.concat_ws("||", F.lower(F.trim(game)), F.lower(F.trim(name)))
