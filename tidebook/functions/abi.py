"""Hex words of contract logs: integers of any width, two's complement, addresses, and strict text forms.

All in JVM columns. ``events`` dispatches whole logs by signature.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: hex digits of a word.
WORD = 64
#: Integers of a word are held as three limbs of 27 digits; a product of a limb and 32 bits fits 38 digits.
LIMB_DIGITS, CHUNK_BITS = 27, 32


def hex_data(raw: Column) -> Column:
    """Lower-case hex text; null counts as '0x'; anything else is an error."""
    text = F.lower(F.coalesce(raw, F.lit("0x")))
    return F.when(text.rlike("^0x[0-9a-f]*$"), text).otherwise(F.raise_error(F.lit("not hex text")))


def words(data: Column) -> Column:
    """Array of the 64-digit words of hex data; a length that is no multiple of a word is an error."""
    text = hex_data(data)
    body = F.substring(text, 3, 2**30)
    count = F.floor(F.length(body) / WORD).cast("int")
    whole = F.when(F.length(body) % WORD == 0, count).otherwise(F.raise_error(F.lit("data is not whole words")).cast("int"))
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.substr(body, i * WORD + 1, F.lit(WORD)))).otherwise(F.array().cast("array<string>"))


def _decimal(value: int, digits: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def small_signed(word: Column) -> Column:
    """A signed word that fits 32 bits, as int."""
    low = F.conv(F.substring(word, 57, 8), 16, 10).cast("bigint")
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _magnitude_text(word: Column, plus: Column) -> Column:
    """Decimal text of an unsigned word plus a small number, without leading zeros."""
    base = 10**LIMB_DIGITS
    chunks = [F.conv(F.substring(word, WORD - 8 * (i + 1) + 1, 8), 16, 10).cast("decimal(10,0)") for i in range(8)]
    sums = []
    for limb in range(3):
        parts = [c * _decimal((1 << CHUNK_BITS * i) // base**limb % base, LIMB_DIGITS) for i, c in enumerate(chunks) if (1 << CHUNK_BITS * i) // base**limb]
        total = parts[0]
        for part in parts[1:]:
            total = (total + part).cast("decimal(38,0)")
        sums.append(total)
    tail = lambda v: F.lpad(F.pmod(v, _decimal(base, LIMB_DIGITS + 1)).cast(f"decimal({LIMB_DIGITS},0)").cast("string"), LIMB_DIGITS, "0")
    carried = lambda v, limb: (limb + F.call_function("div", v, _decimal(base, LIMB_DIGITS + 1)).cast("decimal(20,0)")).cast("decimal(38,0)")
    text = let((sums[0] + plus.cast("decimal(1,0)")).cast("decimal(38,0)"), lambda low: let(carried(low, sums[1]), lambda mid: F.concat(tail(carried(mid, sums[2])), tail(mid), tail(low))))
    return F.regexp_replace(text, "^0+(?=.)", "")


def integer_word(word: Column, signed: bool | Column = False) -> Column:
    """Decimal text of a word of any size; null stays null. Words of up to 64 bits take one conversion."""

    def text(w: Column) -> Column:
        narrow = lambda v: F.substring(v, 1, WORD - 16) == "0" * (WORD - 16)
        low = lambda v: F.conv(F.substring(v, WORD - 15, 16), 16, 10)
        if signed is False:
            return F.when(narrow(w), low(w)).otherwise(_magnitude_text(w, F.lit(0)))
        negative = (F.substring(w, 1, 1) >= "8") & (F.lit(True) if signed is True else signed)
        below = lambda v: F.concat(F.lit("-"), F.when(narrow(v), (low(v).cast("decimal(20,0)") + 1).cast("decimal(21,0)").cast("string")).otherwise(_magnitude_text(v, F.lit(1))))
        return F.when(negative, let(F.translate(w, "0123456789abcdef", "fedcba9876543210"), below)).when(narrow(w), low(w)).otherwise(_magnitude_text(w, F.lit(0)))

    return let(word, text)


def encoded_integer(text: Column) -> Column:
    """The word of an integer given as text, of a magnitude below 10**37; anything else is an error, null stays null."""
    whole, chunk = "decimal(38,0)", _decimal(2**CHUNK_BITS, 10)

    def word(value: Column) -> Column:
        """Words of what is left, from the highest chunk down."""
        rest = lambda v, n: F.lit("") if not n else let(v, lambda x: F.concat(rest(((x - F.pmod(x, chunk)) / chunk).cast(whole), n - 1), F.lpad(F.lower(F.hex(F.pmod(x, chunk).cast("bigint"))), 8, "0")))
        plain = F.lpad(rest(F.when(value < 0, -value - 1).otherwise(value).cast(whole), 4), WORD, "0")
        return F.when(value < 0, F.translate(plain, "0123456789abcdef", "fedcba9876543210")).otherwise(plain)

    return F.when(text.isNotNull(), let(integer_text(text).cast(whole), word))


def address_word(word: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(word, 25, 40)))


def topic_list(topics: Column) -> Column:
    """The array of topics from JSON text."""
    return F.from_json(topics, "array<string>")


def topic_word(topics: Column, i: Column) -> Column:
    """An indexed argument from a JSON list of topics, padded to a word; a missing one is an error."""
    return topic_at(topic_list(topics), i)


def topic_at(topics: Column, i: int | Column) -> Column:
    """The same from an array of topics."""
    topic = F.get(topics, F.lit(i) if isinstance(i, int) else i)
    text = F.lpad(F.substring(hex_data(topic), 3, WORD), WORD, "0")
    return F.when(topic.isNotNull(), text).otherwise(F.raise_error(F.lit("missing topic")))


def integer_text(text: Column) -> Column:
    """Canonical integer text: no leading zeros, no plus sign; anything else is an error. Null stays null."""
    bare = F.trim(text)
    digits = F.regexp_extract(bare, "^[+-]?0*([0-9]+)$", 1)
    sign = F.when(bare.startswith("-") & (digits != "0"), "-").otherwise("")
    return F.when(text.isNull(), None).when(digits != "", F.concat(sign, digits)).otherwise(F.raise_error(F.lit("not an integer")))


def integer_or_zero(text: Column) -> Column:
    """Canonical integer text, with 0 for null and for the spellings of a missing value."""
    return F.coalesce(integer_text(optional_text(text)), F.lit("0"))


def magnitude_text(text: Column) -> Column:
    """Canonical text of the absolute value, null counting as 0."""
    return F.ltrim(integer_or_zero(text), F.lit("-"))


def optional_text(text: Column) -> Column:
    """Null for the spellings of a missing value."""
    return F.when(F.trim(text).isin("", "<NA>", "nan", "None"), None).otherwise(text)


def event_id(transaction: Column, log: Column) -> Column:
    return F.concat_ws(":", transaction, log.cast("string"))


def operation_id(entry: Column, exit_: Column) -> Column:
    return F.sha2(F.concat_ws("|", entry, exit_), 256)
