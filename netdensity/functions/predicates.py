"""Tag rules as boolean columns. ``tag(name)`` gives the value of a tag, or null; the source may be a map or wide columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tag = Callable[[str], Column]

# What counts as walkable, and which values of foot and access allow or forbid it.
WALKABLE = (
    "residential", "living_street", "unclassified", "service", "pedestrian", "footway", "path", "steps", "track", "corridor",
    "cycleway", "bridleway", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link",
)
FOOT_YES, FOOT_NO, ACCESS_NO = ("yes", "designated", "permissive"), ("no", "private", "use_sidepath"), ("no", "private")


def in_map(tags: str) -> Tag:
    return lambda name: F.try_element_at(F.col(tags), F.lit(name))


def among(value: Column, names) -> Column:
    """Whether a value is one of the names; a missing value is not."""
    return F.coalesce(value.isin(*names), F.lit(False)) if names else F.lit(False)


def permitted(tag: Tag) -> Column:
    """Walking is allowed on foot outright, or forbidden neither on foot nor by access."""
    return among(tag("foot"), FOOT_YES) | (~among(tag("foot"), FOOT_NO) & ~among(tag("access"), ACCESS_NO))


def walking(tag: Tag) -> Column:
    """Permitted, and a walkable highway or any highway with an outright permission."""
    highway = tag("highway")
    explicit = highway.isNotNull() & (highway != "") & among(tag("foot"), FOOT_YES)
    return permitted(tag) & (among(highway, WALKABLE) | F.coalesce(explicit, F.lit(False)))


def destination(tag: Tag, allow: dict[str, list[str]], deny: dict[str, list[str]], *, star_alone: bool = False, present: set[str] | None = None) -> Column:
    """Any allow rule and no deny rule. ``*`` allows every value: wherever it stands in a list, or (``star_alone``) only as the whole list.

    ``present`` names the tags that the table has; rules on others are skipped."""
    yes, no = F.lit(False), F.lit(False)
    for name, values in allow.items():
        if present is None or name in present:
            every = values == ["*"] if star_alone else "*" in values
            yes = yes | (tag(name).isNotNull() if every else among(tag(name), values))
    for name, values in deny.items():
        if present is None or name in present:
            no = no | among(tag(name), values)
    return yes & ~no


def access_allowed(tag: Tag) -> Column:
    return F.coalesce(tag("access") != "no", F.lit(True))
