"""JSON document expressions.

All of them are native column expressions. Exact numbers matter: two documents
are equal when their numbers are equal *by value*, and a number that a 96-bit
decimal cannot hold exactly is refused, so number tokens are rewritten to plain
decimals before the text is parsed into a VARIANT.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text

# Possessive quantifiers keep the regex engine iterative on long strings.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
NUMBER_PARTS = r"^-?(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$"
MAX_DECIMAL = "79228162514264337593543950335"  # fixed value: 2^96 - 1
MAX_SCALE = 28
INTEGER_TEXT = r"\A-?[0-9]+\z"

# Property names that may never be stored, compared without case.
RESTRICTED_KEYS = (
    "password",
    "token",
    "accesstoken",
    "refreshtoken",
    "authorization",
    "cookie",
    "secret",
    "apikey",
)


def _number(token: Column) -> tuple[Column, Column, Column]:
    """Significant digits, power of ten and exponent validity of a number token."""
    whole = F.regexp_extract(token, NUMBER_PARTS, 1)
    fraction = F.regexp_extract(token, NUMBER_PARTS, 2)
    exponent_text = F.regexp_extract(token, NUMBER_PARTS, 3)
    exponent = F.when(exponent_text == "", F.lit(0)).otherwise(exponent_text.try_cast("int")).cast("bigint")
    digits = F.regexp_replace(F.concat(whole, fraction), r"^0+", "")
    core = F.regexp_replace(digits, r"0+$", "")
    power = exponent - F.length(fraction) + F.length(digits) - F.length(core)
    return core, power, exponent.isNotNull()


def is_exact_number(token: Column) -> Column:
    """True when the value fits a 96-bit integer scaled by at most 10^-28."""
    core, power, valid = _number(token)
    zeros = F.when((power > 0) & (power < 30), power).otherwise(F.lit(0)).cast("int")
    whole = F.concat(core, F.repeat(F.lit("0"), zeros))
    fits = F.when(F.length(whole) <= 29, whole.try_cast("decimal(38,0)") <= F.lit(MAX_DECIMAL).cast("decimal(38,0)"))
    exact = valid & ((core == "") | ((power >= -MAX_SCALE) & (power < 30) & F.coalesce(fits, F.lit(False))))
    # Numbers of at most 28 digits without an exponent fit in any case: the usual path is one test.
    return F.when(token.rlike(r"^-?\d{1,14}(?:\.\d{1,14})?$"), F.lit(True)).otherwise(exact)


def plain_number(token: Column) -> Column:
    """The shortest plain decimal text of a number token, as ``1`` for ``1.0`` or ``1e0``."""
    core, power, _ = _number(token)
    sign = F.when(token.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    size = F.length(core)
    bounded = F.when(F.abs(power) <= 64, power).otherwise(F.lit(0)).cast("int")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(-bounded - size + 1, F.lit(0))), core)
    cut = F.length(padded) + bounded
    value = (
        F.when(bounded >= 0, F.concat(core, F.repeat(F.lit("0"), F.greatest(bounded, F.lit(0)))))
        .otherwise(F.concat(F.substr(padded, F.lit(1), cut), F.lit("."), F.substr(padded, cut + 1)))
    )
    # Powers outside the bound cannot be exact: leave the token for the exactness rule to refuse.
    scaled = F.when(core == "", F.lit("0")).when(F.abs(power) <= 64, F.concat(sign, value)).otherwise(token)
    # Without an exponent only trailing zeros have to go.
    short = F.regexp_replace(token, r"\.?0+$", "")
    return (
        F.when(token.rlike("[eE]"), scaled)
        .when(token.contains("."), F.when(short.isin("-0", "0", "-"), F.lit("0")).otherwise(short))
        .otherwise(F.when(token == "-0", F.lit("0")).otherwise(token))
    )


def needs_rewriting(bones: Column) -> Column:
    """Whether the document has fractions, exponents or a negative zero outside strings."""
    return bones.rlike(r"\d[.eE]|-0")


def plain_numbers(raw: Column) -> Column:
    """Rewrite the number tokens outside strings as plain decimals."""
    tokens = F.regexp_extract_all(raw, F.lit(rf'(?s){STRING}|{NUMBER}|[^"\d\-]++|.'), F.lit(0))
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t.rlike(r"^-?\d.*[.eE]|^-0$"), plain_number(t)).otherwise(t)), ""
    )


def parsed(raw: Column, bones: Column | None = None) -> Column:
    """VARIANT with exact numbers; NULL for invalid JSON."""
    rewrite = needs_rewriting(skeleton(raw) if bones is None else bones)
    exact = F.when(F.try_parse_json(raw).isNotNull(), F.try_parse_json(plain_numbers(raw)))
    return F.when(rewrite, exact).otherwise(F.try_parse_json(raw))


def skeleton(raw: Column) -> Column:
    """The document with each string reduced to one mark and white space outside strings removed."""
    return F.regexp_replace(F.regexp_replace(raw, STRING, '"'), r"[ \t\r\n]+", "")


def containers_within(bones: Column, levels: int) -> Column:
    """True when one value remains after folding ``levels`` layers of innermost containers."""
    for _ in range(levels):
        bones = F.regexp_replace(bones, r"[\[{][^\[\]{}]*+[\]}]", "#")
    return bones == "#"


def entry_count(bones: Column) -> Column:
    """Object members plus array items at every level."""
    return F.regexp_count(bones, F.lit(",")) + F.regexp_count(bones, F.lit(r"[\[{](?![\]}])"))


def canonical(raw: Column) -> Column:
    """Sorted keys at every level, numbers by value, arrays in order; NULL for invalid JSON."""
    return F.to_json(parsed(raw))


def document_ok(doc: Column, bones: Column | None = None) -> Column:
    """The stored-property rule on canonical text: containers, entries, keys, strings and numbers within bounds."""
    bones = skeleton(doc) if bones is None else bones
    tokens = F.regexp_extract_all(doc, F.lit(f"{STRING}:?"), F.lit(0))
    one_char = r"\\(?:u[0-9a-fA-F]{4}|.)"

    def bad_key(token: Column) -> Column:
        name = F.substr(token, F.lit(2), F.length(token) - 3)
        plain = F.regexp_replace(name, one_char, "_")
        return (
            text.is_blank(plain)
            | (F.length(plain) > 100)
            # Canonical text escapes only quotes, backslashes and control characters.
            | F.regexp_replace(name, r'\\["\\/]', "_").rlike(r"\\|\p{Cc}")
            | F.lower(name).isin(*RESTRICTED_KEYS)
        )

    def bad_value(token: Column) -> Column:
        return F.length(F.regexp_replace(token, one_char, "_")) - 2 > 2048

    numbers = F.regexp_extract_all(bones, F.lit(NUMBER), F.lit(0))
    return F.coalesce(
        containers_within(bones, 4)
        & (entry_count(bones) <= 64)
        & ~F.exists(tokens, lambda t: F.when(t.endswith(":"), bad_key(t)).otherwise(bad_value(t)))
        & F.forall(numbers, is_exact_number),
        F.lit(False),
    )


def has_key(doc: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def top_level(doc: Column) -> Column:
    """Top-level members as MAP<STRING, VARIANT>: a key is a name, never a path."""
    return F.from_json(doc, "map<string,variant>")


def text_member(doc: Column, key: str) -> Column:
    """``->>``: the member as text, NULL when absent or JSON null."""
    return F.get_json_object(doc, f"$.{key}") if re.fullmatch(r"\w+", key) else F.try_variant_get(
        F.element_at(top_level(doc), F.lit(key)), "$", "string"
    )


def exact_decimal(source: str) -> bool:
    """Driver-side twin of :func:`is_exact_number` for filter arguments."""
    sign, digits, power = Decimal(source).as_tuple()
    core = "".join(map(str, digits)).lstrip("0")
    kept = core.rstrip("0")
    power += len(core) - len(kept)
    if not kept:
        return True
    return -MAX_SCALE <= power < 30 and int(kept) * 10 ** max(power, 0) <= int(MAX_DECIMAL)


def parse_scalar(source: str):
    """A JSON scalar argument; numbers stay exact as Decimal. Raises ValueError."""
    if len(source) > 4096:
        raise ValueError("too long")

    def refuse(name):
        raise ValueError(name)

    value = json.loads(source, parse_float=Decimal, parse_int=Decimal, parse_constant=refuse)
    if isinstance(value, (dict, list)):
        raise ValueError("not a scalar")
    if isinstance(value, Decimal) and not exact_decimal(str(value)):
        raise ValueError("not an exact decimal")
    return value


def member_equals(doc: Column, key: str, value_json: str) -> Column:
    """Type-aware equality of one top-level member: 1 = 1.0, "1" <> 1, null <> missing.

    Stored documents are canonical, so a scalar equals the argument exactly when
    their JSON texts are equal. Keys are names: anything but a plain word is
    looked up in a map and never becomes part of a path.
    """
    value = parse_scalar(value_json)
    simple_key = re.fullmatch(r"[A-Za-z0-9_]+", key) is not None
    if simple_key:
        member = F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "variant")
    else:
        member = F.element_at(top_level(doc), F.lit(key))
    if isinstance(value, str) and not re.fullmatch(r'[^"\\\x00-\x1f\x7f-\x9f\u2028\u2029]*', value):
        # The text form of such a string depends on escapes: compare the decoded value.
        kind, shown = F.schema_of_variant(member), F.try_variant_get(member, "$", "string")
        return F.coalesce((kind == "STRING") & (shown == value), F.lit(False))
    if isinstance(value, Decimal):
        wanted = format(value.normalize() if value else Decimal(0), "f")
    else:
        wanted = json.dumps(value, ensure_ascii=False)
    exact = F.coalesce(F.to_json(member) == wanted, F.lit(False))
    # In a canonical document the member occurs literally: a cheap test before parsing.
    return doc.contains(f'"{key}":{wanted}') & exact if simple_key else exact
