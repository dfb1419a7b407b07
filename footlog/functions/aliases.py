"""Made-up, stable display names read off a hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a person's display name.
PERSON_ADJECTIVES = [
    "Amber", "Azure", "Bold", "Brave", "Bright", "Calm", "Clever", "Coral", "Crisp", "Dapper", "Eager", "Fancy",
    "Gentle", "Golden", "Happy", "Hazel", "Indigo", "Jolly", "Keen", "Lively", "Lucky", "Mellow", "Misty", "Noble",
    "Olive", "Plucky", "Quiet", "Rapid", "Rosy", "Rustic", "Sandy", "Silver", "Sleek", "Snowy", "Sunny", "Swift",
    "Tidy", "Velvet", "Vivid", "Witty", "Zesty", "Breezy", "Cosmic", "Dusky", "Frosty", "Lunar", "Polar", "Solar",
]
PERSON_ANIMALS = [
    "Falcon", "Otter", "Fox", "Heron", "Lynx", "Panda", "Badger", "Beaver", "Bison", "Crane", "Dolphin", "Eagle",
    "Ferret", "Gecko", "Hare", "Ibis", "Jaguar", "Koala", "Lemur", "Marten", "Newt", "Ocelot", "Owl", "Puffin",
    "Quail", "Raven", "Seal", "Swan", "Tapir", "Turtle", "Viper", "Walrus", "Wombat", "Yak", "Zebra", "Bear",
    "Robin", "Moth", "Whale", "Wolf", "Orca", "Kiwi", "Llama", "Mole", "Pelican", "Sparrow", "Stork", "Toucan",
]
# The words of a recording's display name.
RECORDING_ADJECTIVES = [
    "Amber", "Azure", "Brisk", "Calm", "Coral", "Crimson", "Dusky", "Eager", "Fleet", "Gentle", "Golden", "Hazel",
    "Indigo", "Jade", "Keen", "Lively", "Lunar", "Mellow", "Misty", "Noble", "Olive", "Pale", "Quiet", "Rapid",
    "Rustic", "Sable", "Silver", "Sunny", "Tidal", "Umber", "Velvet", "Wild",
]
RECORDING_ANIMALS = [
    "Albatross", "Badger", "Beaver", "Bison", "Crane", "Dolphin", "Falcon", "Ferret", "Finch", "Fox", "Gecko",
    "Heron", "Ibex", "Jackal", "Koala", "Lemur", "Lynx", "Marten", "Moose", "Newt", "Ocelot", "Otter", "Owl",
    "Panda", "Puffin", "Quail", "Raven", "Seal", "Stoat", "Tapir", "Walrus", "Wren",
]


def _word(words: list[str], hashed: Column, start: int) -> Column:
    index = F.coalesce(F.conv(F.substring(hashed, start, 4), 16, 10).cast("long"), F.lit(0))
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(index, F.lit(len(words))).cast("int"))


def person_alias(identity: Column) -> Column:
    """Two words and six hex characters, the same on every page."""
    words = F.concat_ws(" ", _word(PERSON_ADJECTIVES, identity, 1), _word(PERSON_ANIMALS, identity, 5))
    return F.concat(words, F.lit(" · "), F.substring(identity, 1, 6))


def recording_name(visitor: Column) -> Column:
    return F.concat_ws(" ", _word(RECORDING_ADJECTIVES, visitor, 1), _word(RECORDING_ANIMALS, visitor, 5))
