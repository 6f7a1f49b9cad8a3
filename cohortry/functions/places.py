"""Column expressions that read ``City, Region, Country`` entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.records import record
from cohortry.functions.text import clean_text

REMOTE = "Remote"

# Country spellings that mean the same country.
COUNTRY_ALIASES = {
    "USA": "United States",
    "US": "United States",
    "U.S.": "United States",
    "United States of America": "United States",
    "UK": "United Kingdom",
}


def country_name(text: Column) -> Column:
    aliases = F.create_map(*[F.lit(word) for pair in COUNTRY_ALIASES.items() for word in pair])
    return F.coalesce(F.try_element_at(aliases, text), text)


def is_remote(place: Column) -> Column:
    return F.coalesce(F.lower(place) == REMOTE.lower(), F.lit(False))


def parse_places(entries: Column) -> Column:
    """List of structs place_raw, city, region, country, is_remote for cleaned entries.

    The last part is the country, the first of several the city, all between
    them the region.  ``Remote`` is a flag and no place.
    """

    def split(place: Column) -> Column:
        parts = F.filter(F.transform(F.split(place, ","), lambda p: F.trim(p)), lambda p: p != "")
        return record(place=place, parts=F.when(~is_remote(place), parts))

    def name(entry: Column) -> Column:
        parts, n = entry["parts"], F.size(entry["parts"])
        between = F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), ", ")
        return record(
            place_raw=entry["place"],
            city=F.when(n > 1, F.try_element_at(parts, F.lit(1))),
            region=F.when(n > 2, between),
            country=country_name(F.try_element_at(parts, F.lit(-1))),
            is_remote=is_remote(entry["place"]),
        )

    return F.transform(F.transform(entries, split), name)


def parse_place(entry: Column) -> Column:
    """The struct for one entry of any text."""
    return parse_places(F.array(clean_text(entry)))[0]


def primary_place(places: Column) -> Column:
    """First parsed place that is not remote, or null."""
    return F.try_element_at(F.filter(places, lambda place: ~place["is_remote"]), F.lit(1))


def first_physical(entries: Column) -> Column:
    """First cleaned entry that is not remote, or null."""
    return F.try_element_at(F.filter(entries, lambda entry: ~is_remote(entry)), F.lit(1))
