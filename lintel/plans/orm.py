"""Model files to catalog columns: Prisma schemas, Django models, TypeORM entities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.catalog import COLUMNS

#: Types of fields. Fixed values.
PRISMA = {"String": "text", "Int": "integer", "BigInt": "bigint", "Float": "double precision", "Decimal": "decimal", "Boolean": "boolean", "DateTime": "timestamptz", "Json": "jsonb", "Bytes": "bytea"}
DJANGO = {
    "AutoField": "integer", "BigAutoField": "bigint", "SmallAutoField": "smallint", "TextField": "text", "IntegerField": "integer", "PositiveIntegerField": "integer",
    "PositiveSmallIntegerField": "smallint", "BigIntegerField": "bigint", "SmallIntegerField": "smallint", "FloatField": "double precision", "BooleanField": "boolean",
    "DateField": "date", "DateTimeField": "timestamptz", "TimeField": "time", "UUIDField": "uuid", "JSONField": "jsonb", "BinaryField": "bytea", "ForeignKey": "integer", "OneToOneField": "integer",
}
DJANGO_LENGTH = {"CharField": 255, "EmailField": 254, "URLField": 200, "SlugField": 50, "FileField": 100, "ImageField": 100}
TYPESCRIPT = {"string": "character varying", "number": "integer", "boolean": "boolean", "Date": "timestamp", "bigint": "bigint"}


def snake(name: str) -> str:
    return re.sub(r"([a-z\d])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()


def plural(word: str) -> str:
    low = word.lower()
    if not word or low.endswith("ies") or (low.endswith("s") and not low.endswith("ss")):
        return word
    if low.endswith("y") and low[-2:-1] not in set("aeiou"):
        return word[:-1] + "ies"
    return word + ("es" if low.endswith(("s", "sh", "ch", "x", "z")) else "s")


def nested(text: str, at: int) -> str:
    """What stands between the parenthesis at ``at`` and its partner."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] in "({[") - (text[k] in ")}]")
        if not depth:
            return text[at + 1 : k]
    return text[at + 1 :]


def option(args: str, name: str) -> str | None:
    m = re.search(rf"\b{name}\s*[=:]\s*(?:'([^']*)'|\"([^\"]*)\"|([^,)}}\s]+))", args)
    return next((g for g in m.groups() if g is not None), None) if m else None


def row(table, name, kind, nullable=True, pk=False, ref=None, ref_column=None, default=None) -> tuple:
    return (table, name, kind, nullable and not pk, pk, ref is not None, ref, ref_column, default)


def prisma(text: str) -> Iterator[tuple]:
    text = re.sub(r"//[^\n]*", "", text)
    models = {m[1]: m[2] for m in re.finditer(r"\bmodel\s+(\w+)\s*\{(.*?)\n\s*\}", text, re.S)}
    enums = set(re.findall(r"\benum\s+(\w+)", text))
    table = {k: (re.search(r"@@map\(\s*\"([^\"]+)\"", v) or [None, k])[1] for k, v in models.items()}
    for model, body in models.items():
        ids = re.findall(r"\w+", (re.search(r"@@id\(\s*\[([^\]]*)\]", body) or [None, ""])[1])
        keys: dict[str, tuple[str, str]] = {}
        for line in body.splitlines():
            if r := re.search(r"^\s*\w+\s+(\w+)[?\[\]]*\s.*@relation\([^)]*fields:\s*\[([^\]]*)\][^)]*references:\s*\[([^\]]*)\]", line):
                keys |= {f: (table.get(r[1], r[1]), c) for f, c in zip(re.findall(r"\w+", r[2]), re.findall(r"\w+", r[3]))}
        for line in body.splitlines():
            m = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)", line)
            if not m or m[2] in models or line.strip().startswith("@@"):
                continue
            rest = m[5]
            kind = (PRISMA.get(m[2]) or (f"enum({m[2]})" if m[2] in enums else m[2].lower())) + (m[3] or "")
            d = rest.find("@default(")
            name = (re.search(r"@map\(\s*\"([^\"]+)\"", rest) or [None, m[1]])[1]
            yield row(table[model], name, kind, bool(m[4]), "@id" in rest or m[1] in ids, *keys.get(m[1], (None, None)), default=nested(rest, d + 8) if d >= 0 else None)


def django(text: str, known: dict[str, str] | None = None) -> Iterator[tuple]:
    """known: tables of the classes of other files."""
    text = re.sub(r"(?m)#[^\n]*$", "", text)
    classes = [(m[1], m.end()) for m in re.finditer(r"(?m)^class\s+(\w+)\s*\([^)]*models\.Model[^)]*\)\s*:", text)]
    bodies = {name: text[at : next((n.start() + at for n in [re.search(r"(?m)^\S", text[at:])] if n), len(text))] for name, at in classes}
    own = {c: option(b, "db_table") or plural(snake(c)) for c, b in bodies.items()}
    table = (known or {}) | own
    for name, body in bodies.items():
        for m in re.finditer(r"(?m)^[ \t]+(\w+)\s*=\s*models\.(\w+)\s*\(", body):
            args, kind = nested(body, m.end() - 1), m[2]
            if kind in DJANGO_LENGTH:
                sql = f"varchar({option(args, 'max_length') or DJANGO_LENGTH[kind]})"
            elif kind == "DecimalField":
                sql = f"decimal({option(args, 'max_digits') or 10},{option(args, 'decimal_places') or 0})"
            elif kind in DJANGO:
                sql = DJANGO[kind]
            else:
                continue
            pk, null = option(args, "primary_key") == "True", option(args, "null") == "True"
            if kind in ("ForeignKey", "OneToOneField"):
                to = (re.match(r"\s*(?:to\s*=\s*)?['\"]?([\w.]+)", args) or [None, ""])[1].split(".")[-1]
                yield row(own[name], option(args, "db_column") or m[1] + "_id", sql, null, pk, own[name] if to == "self" else table.get(to, plural(snake(to))), "id")
            else:
                yield row(own[name], option(args, "db_column") or m[1], sql, null, pk or kind.endswith("AutoField"), default=option(args, "default"))


def typeorm(text: str) -> Iterator[tuple]:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    found = [(m, m.end()) for m in re.finditer(r"@Entity\s*\(([^)]*)\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*\{", text)]
    name_of = lambda m: option(m[1], "name") or (re.search(r"['\"]([^'\"]+)['\"]", m[1]) or [None, plural(snake(m[2]))])[1]
    tables = {m[2]: name_of(m) for m, _ in found}
    for m, at in found:
        body, table = nested(text, at - 1), tables[m[2]]
        for p in re.finditer(r"((?:@\w+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*)+)(?:readonly\s+)?(\w+)([?!])?\s*:\s*([\w\[\]| ]+)", body):
            marks, prop, opt, ts = p[1], p[2], p[3], p[4]
            kinds = set(re.findall(r"@(\w+)", marks))
            args = marks[marks.find("(") :]
            if kinds & {"OneToMany", "ManyToMany"}:
                continue
            if kinds & {"ManyToOne", "OneToOne"}:
                to = (re.search(r"=>\s*(\w+)", args) or [None, ""])[1]
                if to and (kinds & {"ManyToOne", "JoinColumn"}):
                    join = re.search(r"@JoinColumn\s*\(([^)]*)\)", marks)
                    yield row(table, (option(join[1], "name") if join else None) or prop + "Id", "integer", option(args, "nullable") != "false", False, tables.get(to, plural(snake(to))), "id")
                continue
            if kinds & {"Column", "PrimaryColumn", "PrimaryGeneratedColumn", "CreateDateColumn", "UpdateDateColumn", "DeleteDateColumn", "VersionColumn"}:
                plain = re.match(r"\(\s*['\"]([\w ]+)['\"]", args)
                kind = option(args, "type") or (plain[1] if plain and plain[1] not in ("uuid", "increment") else None) or ("uuid" if plain and plain[1] == "uuid" else None)
                kind = kind or ("timestamp" if any(k.endswith("DateColumn") for k in kinds) else TYPESCRIPT.get(ts.strip(), "text"))
                if option(args, "length"):
                    kind += f"({option(args, 'length')})"
                pk = bool(kinds & {"PrimaryColumn", "PrimaryGeneratedColumn"})
                yield row(table, option(args, "name") or prop, kind, option(args, "nullable") == "true" or opt == "?" or "DeleteDateColumn" in kinds, pk, default=option(args, "default"))


def prisma_indexes(text: str) -> Iterator[tuple]:
    """(table, index name, columns, unique) of @unique, @@unique and @@index, by the columns' mapped names."""
    text = re.sub(r"//[^\n]*", "", text)
    for m in re.finditer(r"\bmodel\s+(\w+)\s*\{(.*?)\n\s*\}", text, re.S):
        body = m[2]
        table = (re.search(r"@@map\(\s*\"([^\"]+)\"", body) or [None, m[1]])[1]
        mapped = {f[1]: (re.search(r"@map\(\s*\"([^\"]+)\"", f[0]) or [None, f[1]])[1] for f in re.finditer(r"(?m)^\s*(\w+)\s+\w+.*$", body)}
        for f in re.finditer(r"(?m)^\s*(\w+)\s+\w+.*(?<!@)@unique\b.*$", body):
            yield table, f"uq_{table}_{mapped[f[1]]}", [mapped[f[1]]], True
        for f in re.finditer(r"@@(unique|index)\(\s*(?:fields:\s*)?\[([^\]]*)\]([^\n]*)", body):
            cols = [mapped.get(c, c) for c in re.findall(r"\w+", f[2])]
            name = re.search(r"(?:map|name):\s*\"([^\"]+)\"", f[3])
            yield table, name[1] if name else f"{'uq' if f[1] == 'unique' else 'idx'}_{table}_{'_'.join(cols)}", cols, f[1] == "unique"


def django_indexes(text: str) -> Iterator[tuple]:
    """(table, index name, columns, unique) of fields that are unique."""
    text = re.sub(r"(?m)#[^\n]*$", "", text)
    for m in re.finditer(r"(?m)^class\s+(\w+)\s*\([^)]*models\.Model[^)]*\)\s*:((?:\n(?:[ \t]+[^\n]*)?)*)", text):
        table = option(m[2], "db_table") or plural(snake(m[1]))
        for f in re.finditer(r"(?m)^[ \t]+(\w+)\s*=\s*models\.(\w+)\s*\(", m[2]):
            args = nested(m[2], f.end() - 1)
            if option(args, "unique") == "True":
                name = option(args, "db_column") or (f[1] + "_id" if f[2] in ("ForeignKey", "OneToOneField") else f[1])
                yield table, f"uq_{table}_{name}", [name], True


def typeorm_indexes(text: str) -> Iterator[tuple]:
    """(table, index name, columns, unique) of columns that are unique."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    for m in re.finditer(r"@Entity\s*\(([^)]*)\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*\{", text):
        table = option(m[1], "name") or (re.search(r"['\"]([^'\"]+)['\"]", m[1]) or [None, plural(snake(m[2]))])[1]
        for p in re.finditer(r"@Column\s*\(([^()]*)\)\s*(?:readonly\s+)?(\w+)[?!]?\s*:", nested(text, m.end() - 1)):
            if option(p[1], "unique") == "true":
                name = option(p[1], "name") or p[2]
                yield table, f"uq_{table}_{name}", [name], True


INDEXES = {"prisma": prisma_indexes, "django": django_indexes, "typeorm": typeorm_indexes}


def model_indexes(files: DataFrame, schema_id: str = "models") -> DataFrame:
    """schema_id, table_name, index_name, columns, is_unique of model files (path, text, kind)."""

    def parse(frames):
        for f in frames:
            rows = [(schema_id, *r) for text, kind in zip(f["text"], f["kind"]) for r in INDEXES[kind](text)]
            yield pd.DataFrame(rows, columns=["schema_id", "table_name", "index_name", "columns", "is_unique"])

    return files.select("text", "kind").mapInPandas(parse, "schema_id string, table_name string, index_name string, columns array<string>, is_unique boolean")


PARSERS = {"prisma": prisma, "django": django, "typeorm": typeorm}


def models(files: DataFrame, schema_id: str = "models") -> DataFrame:
    """Columns of model files (path, text, kind). Files are independent, so each is parsed where it is read."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def parse(frames):
        for f in frames:
            rows = []
            for text, kind in zip(f["text"], f["kind"]):
                place: dict[str, int] = {}
                for r in PARSERS[kind](text):
                    k = place[r[0]] = place.get(r[0], -1) + 1
                    rows.append((schema_id, r[0], r[1], k, *r[2:]))
            yield pd.DataFrame(rows, columns=names)

    return files.select("text", "kind").mapInPandas(parse, COLUMNS)
