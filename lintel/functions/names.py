"""Names and types: similarity, normal forms, synonyms, type families and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words for one meaning, and the name a merged column gets. Fixed values.
SYNONYMS = {
    "phone": ["phone", "mobile", "cell", "telephone", "phone_number", "mobile_number", "cell_number", "tel", "contact_number"],
    "email": ["email", "email_address", "mail", "e_mail", "user_email", "contact_email"],
    "name": ["name", "full_name", "fullname", "display_name", "user_name", "username"],
    "first_name": ["first_name", "firstname", "fname", "given_name"],
    "last_name": ["last_name", "lastname", "lname", "surname", "family_name"],
    "address": ["address", "street", "street_address", "addr", "location"],
    "city": ["city", "city_name", "town"],
    "zip": ["zip", "zipcode", "zip_code", "postal_code", "postcode"],
    "country": ["country", "country_code", "nation"],
    "date_of_birth": ["date_of_birth", "dob", "birth_date", "birthdate", "born_on"],
    "created_at": ["created_at", "created_date", "creation_date", "date_created", "insert_date"],
    "updated_at": ["updated_at", "updated_date", "modified_at", "modified_date", "last_modified", "last_updated"],
    "deleted_at": ["deleted_at", "deleted_date", "removed_at", "soft_delete"],
    "status": ["status", "state", "is_active", "active", "enabled", "flag"],
    "description": ["description", "desc", "details", "info", "notes", "comment", "remarks"],
    "amount": ["amount", "price", "cost", "value", "total", "sum"],
    "quantity": ["quantity", "qty", "count", "num", "number"],
    "image": ["image", "image_url", "photo", "photo_url", "avatar", "avatar_url", "picture", "thumbnail"],
    "token": ["token", "access_token", "auth_token", "api_key", "secret_key", "api_token"],
}
CANONICAL = {"phone": "phone_number", "name": "full_name", "address": "street_address", "zip": "postal_code", "country": "country_code", "image": "image_url", "token": "access_token"}
#: Families of types; castable pairs; the merge's groups and its order from general to special. Fixed values.
FAMILIES = {
    "integer": ["int", "integer", "bigint", "smallint", "tinyint", "mediumint", "serial", "bigserial"],
    "float": ["float", "double", "real", "numeric", "decimal", "double precision"],
    "text": ["varchar", "char", "text", "nvarchar", "nchar", "tinytext", "mediumtext", "longtext", "character varying"],
    "boolean": ["bool", "boolean"],
    "datetime": ["date", "time", "datetime", "timestamp", "timestamptz", "timetz"],
    "binary": ["blob", "bytea", "binary", "varbinary"],
    "json": ["json", "jsonb"],
    "uuid": ["uuid"],
}
CASTABLE = [("integer", "float"), ("float", "integer"), ("integer", "text"), ("float", "text"), ("boolean", "integer"), ("datetime", "text"), ("uuid", "text")]
MERGE_GROUPS = [
    ["int", "integer", "bigint", "smallint", "tinyint", "serial", "bigserial"],
    ["float", "double", "real", "decimal", "numeric"],
    ["varchar", "text", "char", "nvarchar", "nchar", "character varying"],
]
GENERALITY = ["bigint", "integer", "smallint", "text", "varchar", "char", "double", "float", "decimal"]


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty names are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b).cast("double") / F.nullif(longest, F.lit(0)))


def normal(name: Column) -> Column:
    """Lower case; what isn't a letter or digit becomes one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2"))


def pluralize(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.when((word == "") | low.endswith("ies") | (low.endswith("s") & ~low.endswith("ss")), word)
        .when(low.endswith("y") & ~low.rlike("[aeiou]y$"), F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("ies")))
        .when(low.rlike("(?:s|sh|ch|x|z)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def model_name(table: Column) -> Column:
    """Class name of a table: words capitalised, made singular."""
    joined = F.array_join(F.transform(F.split(table, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    cut = lambda n: F.substr(joined, F.lit(1), F.length(joined) - n)
    return F.when(joined.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(joined.endswith("ses"), cut(2)).when(joined.endswith("s") & ~joined.endswith("ss"), cut(1)).otherwise(joined)


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def base_type(kind: Column) -> Column:
    """Lower-cased type without its first parenthesis group."""
    return F.trim(F.regexp_replace(F.lower(kind), r"^([^(]*)\([^)]*\)", "$1"))


def type_family(kind: Column) -> Column:
    base, out = base_type(kind), F.lit("unknown")
    for family, kinds in FAMILIES.items():
        out = F.when(base.isin(kinds), F.lit(family)).otherwise(out)
    return out


def type_compatibility(a: Column, b: Column) -> Column:
    fa, fb = type_family(a), type_family(b)
    castable = F.concat_ws(">", fa, fb).isin([f"{x}>{y}" for x, y in CASTABLE])
    return F.when((F.lower(a) == F.lower(b)) | (fa == fb), "compatible").when(castable, "castable").otherwise("incompatible")


def merge_compatible(a: Column, b: Column) -> Column:
    na, nb = base_type(a), base_type(b)
    out = na == nb
    for group in MERGE_GROUPS:
        out = out | (na.isin(group) & nb.isin(group))
    return out


def preferred_type(a: Column, b: Column) -> Column:
    """The more general type; an unlisted one wins, the first before the second."""
    at = lambda t: F.array_position(F.array(*map(F.lit, GENERALITY)), base_type(t))
    return F.when(at(a) == 0, a).when(at(b) == 0, b).when(at(a) <= at(b), a).otherwise(b)


def synonyms(spark: SparkSession) -> DataFrame:
    """meaning, canonical, synonym."""
    return spark.createDataFrame([(m, CANONICAL.get(m, m), s) for m, words in SYNONYMS.items() for s in words], "meaning string, canonical string, synonym string")
