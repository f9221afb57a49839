"""JSON documents and other nested data to flat rows.

Documents are parsed once into variants, so records of different shape can share a column.  The shape of all records
comes from one aggregate; from then on flattening is a chain of projections and ``explode_outer`` steps.  Only a field
that is a list in one record and something else in another costs a further aggregate.

Objects whose keys are data, such as one entry per user, have no shape worth a column per key.  A sketch tells whether
keys are so many before any of them leaves the executors; such objects become rows of key and value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.names import unique_names
from tidyloom.operators.columns import normalize_columns, quoted, tag_in_order
from tidyloom.storage import stage

# Where an object may keep its records, in order of preference.
RECORD_KEYS = ("data", "results", "items", "rows", "records", "response")
SCALAR_COLUMN = "value"
SEPARATOR = "_"
#: An object with about more distinct keys than this over all records is taken as a map.
MAP_WIDTH = 5_000

_LIST = "array<variant>"
_OBJECT = "map<string,variant>"
_STRICT = {"allowSingleQuotes": "false"}
#: Where a record stands: its payload, then its place in it.
_PLACE = ("__payload_seq", "__record_pos")
#: Keys that lead to an object of a record; None steps into the items of a list.
Path = tuple[str | None, ...]


# --- typed nested columns -------------------------------------------------------------------------------------------


def flatten_structs(df: DataFrame) -> DataFrame:
    """Replace every struct column by its fields, named ``parent_child``, down to the last level."""

    def leaves(c: Column, name: str, data_type: T.DataType):
        if not isinstance(data_type, T.StructType):
            return [(name, c)]
        return [
            leaf for f in data_type for leaf in leaves(c.getField(f.name), f"{name}{SEPARATOR}{f.name}", f.dataType)
        ]

    found = [leaf for f in df.schema for leaf in leaves(F.col(quoted(f.name)), f.name, f.dataType)]
    return df.select(*[c.alias(n) for n, (_, c) in zip(unique_names(n for n, _ in found), found)])


def explode_arrays(df: DataFrame, heavy: int | None = None) -> DataFrame:
    """Explode array columns until none is left; an empty array leaves one null row.

    Several arrays in a row give all their combinations.  Structs inside an array become columns at the end.  With
    ``heavy``, rows that make more rows than that are dealt over the cluster by the items of their first array before the
    others are exploded; the rest stay where they are.
    """
    df = flatten_structs(df)
    arrays = [f for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    if heavy is not None and arrays:
        light = explode_arrays(df.where(array_growth(df) <= heavy))
        name = arrays[0].name
        dealt = df.where(array_growth(df) > heavy).select(*[
            F.explode_outer(F.col(quoted(c))).alias(c) if c == name else F.col(quoted(c)) for c in df.columns])
        # Each item once more as an array of its own, so that columns come out in the same places.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(tasks).withColumn(name, F.array(F.col(quoted(name))))
        return light.union(explode_arrays(dealt))
    while True:
        arrays = [f for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        if not arrays:
            return df
        name, element = arrays[0].name, arrays[0].dataType.elementType
        exploded = F.explode_outer(F.col(quoted(name))).alias(name)
        others = [F.col(quoted(c)) for c in df.columns if c != name]
        if isinstance(element, T.StructType):
            df = flatten_structs(df.select(*others, exploded))
        else:
            df = df.select(*[exploded if c == name else F.col(quoted(c)) for c in df.columns])


def array_growth(df: DataFrame) -> Column:
    """How many rows `explode_arrays` makes of each row: the product over its arrays of what their items make."""
    def grows(c: Column, data_type: T.DataType) -> Column | None:
        if isinstance(data_type, T.StructType):
            return _product([grows(c.getField(f.name), f.dataType) for f in data_type])
        if isinstance(data_type, T.ArrayType):
            return _total(c, lambda item: grows(item, data_type.elementType))
        return None

    rows = _product([grows(F.col(quoted(f.name)), f.dataType) for f in df.schema])
    return (F.lit(1) if rows is None else rows).cast("long")


def _product(factors: Iterable[Column | None]) -> Column | None:
    """The product of what is not None; in doubles, which cannot overflow, until it is cut to a long."""
    known = [F.coalesce(f, F.lit(1.0)) for f in factors if f is not None]
    return reduce(lambda a, b: a * b, known) if known else None


def _total(items: Column, grows: Callable[[Column], Column | None]) -> Column:
    """What the items of an array make together; an empty or missing array makes one row."""
    def add(total: Column, item: Column) -> Column:
        grown = grows(item)
        return total + (F.lit(1.0) if grown is None else F.coalesce(grown, F.lit(1.0)))

    return F.coalesce(F.nullif(F.aggregate(items, F.lit(0.0), add), F.lit(0.0)), F.lit(1.0))


# --- JSON text ------------------------------------------------------------------------------------------------------


def is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", _LIST).isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", _OBJECT).isNotNull()


def find_records(doc: Column) -> Column:
    """Records of a parsed document, as an array.

    A list is its items.  An object gives the first of ``RECORD_KEYS`` that holds a list, or else is one record
    itself, like any scalar.  Null without a document.
    """
    return F.coalesce(
        F.try_variant_get(doc, "$", _LIST),
        *[F.try_variant_get(doc, f"$.{key}", _LIST) for key in RECORD_KEYS],
        F.when(doc.isNotNull(), F.array(doc)),
    )


def wrap_scalar(record: Column) -> Column:
    """A record that is no object becomes an object with the single field ``value``."""
    return F.when(is_object(record), record).otherwise(F.to_variant_object(F.struct(record.alias(SCALAR_COLUMN))))


def _parsed(text: Column) -> Column:
    """The document as a variant: null if it is no JSON or too large for one variant.  ``NaN`` counts as a number."""
    return F.coalesce(F.try_parse_json(text), F.from_json(text, "variant", _STRICT))


def _listed(text: Column) -> Column:
    """Records of a list, or of a list under a record key, cut from the text one by one.

    One variant holds 128 MiB; a document may be larger as long as its records are not.  A text without a bracket, even an
    escaped one, has no list and is not looked through once per key.
    """
    found = F.coalesce(
        F.from_json(text, _LIST, _STRICT),
        *[F.from_json(F.get_json_object(text, f"$.{key}"), _LIST, _STRICT) for key in RECORD_KEYS],
    )
    return F.when(text.contains("[") | text.contains("\\"), found)


def _last_key_wins(df: DataFrame) -> None:
    """A key that an object repeats is no error; its last value counts."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def invalid_payloads(df: DataFrame, column: str) -> DataFrame:
    """Rows whose payload is present but gives no records: it is no JSON, or one record of it is above 128 MiB.

    Together with the rows of `record_items` these are all payloads that are not null.
    """
    _last_key_wins(df)
    c = F.col(quoted(column))
    return df.filter(c.isNotNull() & _parsed(c).isNull() & _listed(c).isNull())


def record_items(df: DataFrame, column: str, keep: Iterable[str] = (), broken: str = "skip") -> DataFrame:
    """One row per record of every payload in ``column``: the ``keep`` columns, ``__record_pos`` and a variant
    ``__record``.

    ``broken`` says what becomes of `invalid_payloads`: ``"skip"`` leaves them to the caller, ``"error"`` fails.
    """
    if broken not in ("skip", "error"):
        raise ValueError(f"broken must be skip or error, not {broken!r}")
    _last_key_wins(df)
    kept, text, doc = [F.col(quoted(c)) for c in keep], F.col("__text"), F.col("__doc")
    # No filter on the parsed document: it would be pushed below the projection and parse every payload twice.
    docs = df.select(*kept, F.col(quoted(column)).alias("__text")).select(*kept, "__text", _parsed(text).alias("__doc"))
    records = F.coalesce(find_records(doc), F.when(doc.isNull(), _listed(text)))
    if broken == "error":
        no_json = F.raise_error(F.lit("a document is no valid JSON")).cast(_LIST)
        records = F.coalesce(records, F.when(text.isNotNull(), no_json))
    return docs.select(*kept, F.posexplode(records).alias(_PLACE[1], "__record"))


def _spark_type(described: str) -> T.DataType:
    """Spark type of a variant description; decimals are plain JSON numbers, void is a field that is always null."""
    outside = [
        part if i % 2 else part.replace("OBJECT<", "STRUCT<") for i, part in enumerate(described.split("`"))
    ]

    def settle(t: T.DataType) -> T.DataType:
        if isinstance(t, T.DecimalType):
            return T.DoubleType()
        if isinstance(t, T.NullType):
            return T.StringType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(settle(t.elementType))
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, settle(f.dataType)) for f in t])
        return t

    return settle(T.DataType.fromDDL("`".join(outside)))


def variant_type(df: DataFrame, c: Column) -> T.DataType:
    """Common type of a variant column over all rows."""
    return _spark_type(df.agg(F.schema_of_variant_agg(c)).head()[0] or "VOID")


# --- objects used as maps -------------------------------------------------------------------------------------------

# Places are texts: one step for each key, lists are passed through, and all keys of a map are one step.
_ANY_KEY = "/*"


def _below(place: str, key: str) -> str:
    return f"{place}/{key.encode().hex().upper()}"


def _distinct_names(df: DataFrame, record: Column) -> int:
    """About how many names keys have anywhere in the records: no object has more distinct keys than that."""
    # Without escaped characters a quote before a colon ends a key, but for texts that begin with a colon.
    plain = F.regexp_replace(F.to_json(record), r"\\.", "?")
    pieces = F.split(plain, '":')
    names = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda piece: F.substring_index(piece, '"', -1))
    return df.select(F.explode(names).alias("__name")).agg(F.approx_count_distinct("__name")).head()[0]


def wide_objects(df: DataFrame, record: Column, width: int) -> frozenset[str]:
    """Places of the objects that have about more than ``width`` distinct keys over all records.

    Level by level, each place and its keys are counted by a sketch, so only the places found come to the driver.
    """
    found: set[str] = set()
    level = df.select(F.lit("").alias("__place"), record.alias("__v"))
    place, v = F.col("__place"), F.col("__v")
    while True:
        while level.agg(F.bool_or(is_list(v))).head()[0]:
            level = level.select(place, F.explode(F.coalesce(F.try_variant_get(v, "$", _LIST), F.array(v))).alias("__v"))
        entries = level.select(place, F.explode(F.try_variant_get(v, "$", _OBJECT)).alias("__key", "__v"))
        widths = entries.groupBy(place).agg(F.approx_count_distinct("__key").alias("__n"))
        here, above = widths.agg(F.count("*"), F.collect_list(F.when(F.col("__n") > width, place))).head()
        if not here:
            return frozenset(found)
        found.update(above)
        step = F.concat(F.lit("/"), F.hex("__key"))
        if above:
            step = F.when(place.isin(above), F.lit(_ANY_KEY)).otherwise(step)
        level = entries.select(F.concat(place, step).alias("__place"), v)


def _entries(v: Column) -> Column:
    """Keys and values of an object used as a map; what is no object has one entry without a key."""
    lone = F.array(F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", _OBJECT)), F.when(v.isNotNull(), lone))


def _shape(df: DataFrame, c: Column, place: str = "", wide: frozenset[str] = frozenset()) -> T.DataType:
    """Common type of a variant column that stands at ``place``; the objects in ``wide`` are maps.

    Lists that hold maps somewhere are left as variants, to be looked into once they are exploded.
    """
    below = [w[len(place) + 1:].split("/")[0] for w in wide if w.startswith(f"{place}/")]
    if place not in wide and not below:
        return variant_type(df, c)
    other = c.isNotNull() & ~F.is_variant_null(c) & ~is_list(c) & ~is_object(c)
    has_list, has_object, has_other = df.agg(F.bool_or(is_list(c)), F.bool_or(is_object(c)), F.bool_or(other)).head()
    if has_list:
        return T.VariantType()
    if place in wide:
        return T.MapType(T.StringType(), T.VariantType())
    if has_other or not has_object:
        return T.VariantType() if has_object else variant_type(df, c)
    keys = sorted({bytes.fromhex(k).decode() for k in below})
    rest = F.map_filter(F.try_variant_get(c, "$", _OBJECT), lambda key, _: ~key.isin(keys))
    fields = [T.StructField(key, _shape(df, _member(c, key), _below(place, key), wide)) for key in keys]
    plain = variant_type(df, F.to_variant_object(rest))
    return T.StructType(sorted([*fields, *(plain if isinstance(plain, T.StructType) else [])], key=lambda f: f.name))


@dataclass
class _Field:
    name: str
    value: Column
    type: T.DataType
    place: str = ""

    @property
    def pending(self) -> bool:
        return isinstance(self.type, (T.ArrayType, T.VariantType, T.MapType))


def _member(v: Column, key: str) -> Column:
    """Field of a variant object, whatever characters its key has."""
    if '"' in key or "\\" in key:
        return F.try_variant_get(v, "$", _OBJECT)[key]
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def _fields(v: Column, name: str, data_type: T.DataType, place: str) -> list[_Field]:
    """Flat fields of a variant of known type; lists and maps stay variants until they are exploded."""
    if isinstance(data_type, T.StructType):
        return [
            field for f in data_type
            for field in _fields(_member(v, f.name), f"{name}{SEPARATOR}{f.name}" if name else f.name, f.dataType,
                                 _below(place, f.name))
        ]
    if isinstance(data_type, (T.ArrayType, T.VariantType, T.MapType)):
        return [_Field(name, v, data_type, place)]
    return [_Field(name, F.try_variant_get(v, "$", data_type.simpleString()), data_type, place)]


def _unfold(v: Column, name: str, data_type: T.DataType, place: str) -> tuple[list[_Field], list[_Field]]:
    """Fields of a list item: those that take the list's place and those that go to the end of the row."""
    fields = _fields(v, name, data_type, place)
    return ([], fields) if isinstance(data_type, T.StructType) else (fields, [])


def _settle_mixed(
    df: DataFrame, field: _Field, column: str, wide: frozenset[str]
) -> tuple[DataFrame, list[_Field], list[_Field]]:
    """Give a field whose records disagree a definite shape: lists are exploded, then objects split from scalars."""
    c, name, place = field.value, field.name, field.place
    has_list, has_object = df.agg(F.bool_or(is_list(c)), F.bool_or(is_object(c))).head()
    if has_list:
        df = df.withColumn(column, F.explode_outer(F.coalesce(F.try_variant_get(c, "$", _LIST), F.array(c))))
        return df, *_unfold(c, name, _shape(df, c, place, wide), place)
    text = F.try_variant_get(c, "$", "string")
    if not has_object:
        return df, [_Field(name, text, T.StringType())], []
    whole = F.when(is_object(c), c)
    scalar = _Field(name, F.when(~is_object(c), text), T.StringType())
    return df, [scalar], _fields(whole, name, _shape(df, whole, place, wide), place)


def _settle_map(df: DataFrame, field: _Field, column: str, wide: frozenset[str]) -> tuple[DataFrame, list[_Field]]:
    """One row per entry of an object used as a map: ``name_key``, then the value as ``name_value`` or its fields."""
    under = f"{field.name}{SEPARATOR}" if field.name else ""
    df = df.withColumn(column, F.explode_outer(_entries(field.value)))
    entry = F.col(column)
    value, place = entry.getField("value"), field.place + _ANY_KEY
    key = _Field(f"{under}key", entry.getField("key"), T.StringType())
    return df, [key, *_fields(value, f"{under}value", _shape(df, value, place, wide), place)]


def record_growth(
    df: DataFrame, column: str = "__record", keep: Iterable[str] = (_PLACE[1],)
) -> DataFrame:
    """The ``keep`` columns and ``rows`` of each record: how many rows flattening makes of it.

    Sibling lists of a record give all their combinations, so this is a product, told before anything is exploded.
    It takes every key of an object as a column, as ``map_width=None`` does.
    """
    record = F.col(quoted(column))

    def grows(v: Column, data_type: T.DataType, source: DataFrame, at: Column) -> Column | None:
        """``at`` is the same value as ``v``, but in ``source``, where its items can be looked at."""
        if isinstance(data_type, T.StructType):
            return _product([grows(_member(v, f.name), f.dataType, source, _member(at, f.name)) for f in data_type])
        if isinstance(data_type, T.ArrayType):
            inner, item = _items_of(source, F.try_variant_get(at, "$", _LIST))
            return _total(F.try_variant_get(v, "$", _LIST), lambda i: grows(i, data_type.elementType, inner, item))
        if isinstance(data_type, T.VariantType):  # a list here, something else there: each is taken as a list
            inner, item = _items_of(source, F.coalesce(F.try_variant_get(at, "$", _LIST), F.array(at)))
            kind = variant_type(inner, item)
            if isinstance(kind, T.VariantType):
                if not inner.agg(F.bool_or(is_list(item))).head()[0]:
                    kind = T.StringType()
            return _total(F.coalesce(F.try_variant_get(v, "$", _LIST), F.array(v)), lambda i: grows(i, kind, inner, item))
        return None

    shape = variant_type(df, record)
    if not isinstance(shape, T.StructType):
        df = df.select(*[F.col(quoted(c)) for c in keep], wrap_scalar(record).alias(column))
        shape = variant_type(df, record)
    rows = grows(record, shape, df, record) if isinstance(shape, T.StructType) else None
    return df.select(*[F.col(quoted(c)) for c in keep], (F.lit(1.0) if rows is None else rows).cast("long").alias("rows"))


def _items_of(df: DataFrame, items: Column) -> tuple[DataFrame, Column]:
    return df.select(F.explode(items).alias("__item")), F.col("__item")


def json_growth(df: DataFrame, column: str, keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` columns, ``record`` (from 0) and ``rows`` for each record of JSON payloads, see `record_growth`."""
    keep = list(keep)
    records = record_items(df, column, keep)
    return record_growth(records, keep=[*keep, _PLACE[1]]).withColumnRenamed(_PLACE[1], "record")


def flatten_records(
    df: DataFrame, column: str = "__record", keep: Iterable[str] = (),
    arrange: Callable[[T.DataType], T.DataType] = lambda shape: shape, map_width: int | None = MAP_WIDTH,
) -> DataFrame:
    """Flat rows of a column of variant records: objects to columns, lists to rows, sibling lists combined.

    Columns come by name; ``arrange`` may return the shape of the records with its fields in another order.

    An object with about more than ``map_width`` distinct keys over all records gives one row per key instead, with
    the columns ``name_key`` and ``name_value`` (or ``name_value_field`` for each field, if values are objects), like a
    list; an empty one gives nulls, and a scalar in its place a value without a key.  None takes every key as a column
    and saves a pass.
    """
    keep, record = list(keep), F.col(quoted(column))
    many = map_width is not None and _distinct_names(df, record) > map_width

    def wrapped() -> DataFrame:
        return df.select(*[F.col(quoted(c)) for c in keep], wrap_scalar(record).alias(column))

    wide: frozenset[str] = frozenset()
    if many:
        no_object = record.isNotNull() & ~F.is_variant_null(record) & ~is_object(record)
        if df.agg(F.bool_or(no_object)).head()[0]:
            df = wrapped()
        wide = wide_objects(df, record, map_width)
    shape = _shape(df, record, "", wide)
    if not isinstance(shape, (T.StructType, T.MapType)):
        # Some records are no objects; looking into each of them is needed only then.
        df = wrapped()
        shape = variant_type(df, record)

    def project(frame: DataFrame, found: list[_Field]) -> tuple[DataFrame, list[_Field]]:
        # Columns go by number until the end: JSON keys may differ in case alone.
        frame = frame.select(
            *[F.col(quoted(c)) for c in keep], *[f.value.alias(f"__f{i}") for i, f in enumerate(found)]
        )
        return frame, [_Field(f.name, F.col(f"__f{i}"), f.type, f.place) for i, f in enumerate(found)]

    top = arrange(shape) if isinstance(shape, (T.StructType, T.MapType)) else T.StructType()
    df, fields = project(df, _fields(record, "", top, ""))
    while True:
        at = next((i for i, f in enumerate(fields) if f.pending), None)
        if at is None:
            return df.toDF(*unique_names(keep + [f.name for f in fields]))
        f, numbered = fields[at], f"__f{at}"
        if isinstance(f.type, T.VariantType):
            df, stay, appended = _settle_mixed(df, f, numbered, wide)
        elif isinstance(f.type, T.MapType):
            df, stay = _settle_map(df, f, numbered, wide)
            appended = []
        else:
            df = df.withColumn(numbered, F.explode_outer(F.try_variant_get(f.value, "$", _LIST)))
            stay, appended = _unfold(f.value, f.name, f.type.elementType, f.place)
        df, fields = project(df, fields[:at] + stay + fields[at + 1:] + appended)


def _objects(shape: T.DataType, path: Path = ()) -> Iterator[Path]:
    """Paths of all objects with more than one field."""
    if isinstance(shape, T.ArrayType):
        yield from _objects(shape.elementType, (*path, None))
    elif isinstance(shape, T.StructType):
        if len(shape) > 1:
            yield path
        for f in shape:
            yield from _objects(f.dataType, (*path, f.name))


def _items(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def _step(texts: Column, key: str | None) -> Column:
    """From the texts of objects to those under a key, or from the texts of lists to those of their items."""
    if key is None:
        return F.flatten(F.filter(F.transform(texts, _items), lambda items: items.isNotNull()))
    field = T.StructType([T.StructField(key, T.StringType())])
    return F.transform(texts, lambda text: F.from_json(text, field).getField(key))


def _keys(texts: Column) -> Column:
    """Keys of objects, given as texts, in the order they first appear."""
    keys = F.transform(texts, lambda text: F.map_keys(F.from_json(text, "map<string,string>")))
    return F.array_distinct(F.flatten(F.filter(keys, lambda k: k.isNotNull())))


def _in_document_order(df: DataFrame, column: str, shape: T.DataType, seq: str) -> T.DataType:
    """The shape of the records with the fields of all objects in the order they first appear in the payloads.

    ``seq`` numbers the payloads.  Each is first reduced to one list of keys per object of the shape, then payloads to
    their distinct lists, so what is sorted out at the end is as small as the schema.  Objects in fields whose records
    disagree on a shape stay ordered by name.
    """
    paths = list(_objects(shape))
    if not paths:
        return shape
    text = F.col("__text")
    under = F.from_json(text, ", ".join(f"{key} string" for key in RECORD_KEYS))
    records = F.coalesce(_items(text), *[_items(under.getField(key)) for key in RECORD_KEYS], F.array(text))

    def keys_at(path: Path) -> Column:
        texts = F.col("__records")
        for key in path:
            texts = _step(texts, key)
        return _keys(texts)

    lists = (
        df.select(F.col(seq).alias("__seq"), F.col(quoted(column)).alias("__text"))
        .select("__seq", records.alias("__records"))
        .select("__seq", F.posexplode(F.array(*map(keys_at, paths))).alias("__path", "__keys"))
        .groupBy("__path", "__keys").agg(F.min("__seq").alias("__seq"))
    )
    keys = lists.select("__path", "__seq", F.posexplode("__keys").alias("__pos", "__key"))
    first = keys.groupBy("__path", "__key").agg(F.min(F.struct("__seq", "__pos")).alias("__first"))
    ranks: dict[Path, dict[str, int]] = {path: {} for path in paths}
    for row in first.orderBy("__path", "__first").collect():
        at = ranks[paths[row["__path"]]]
        at[row["__key"]] = len(at)

    def arranged(t: T.DataType, path: Path) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(arranged(t.elementType, (*path, None)))
        if not isinstance(t, T.StructType):
            return t
        rank = ranks.get(path, {})
        fields = sorted(t, key=lambda f: rank.get(f.name, len(rank)))
        return T.StructType([T.StructField(f.name, arranged(f.dataType, (*path, f.name))) for f in fields])

    return arranged(shape, ())


def flatten_json(
    df: DataFrame, column: str, keep: Iterable[str] = (), document_order: bool = True, tag: bool = False,
    broken: str = "skip", map_width: int | None = MAP_WIDTH,
) -> DataFrame:
    """Parse, find the records, flatten, explode and clean the names: payload text in, flat rows out.

    ``document_order`` puts columns in the order keys appear in the text, at the price of one more pass; otherwise
    they come by name.  ``tag`` adds the row sequence, in the order of payloads and of records within them.  Neither
    depends on whether the input is staged.  For ``broken`` see `record_items`, for ``map_width`` `flatten_records`.
    """
    keep, seq = list(keep), _PLACE[0]
    tagged = df.select(*[F.col(quoted(c)) for c in [*keep, column]]).withColumn(seq, F.monotonically_increasing_id())
    staged = stage(tagged)
    place = list(_PLACE) if tag else []
    records = record_items(staged, column, [*keep, seq], broken)
    moved = staged is not tagged
    if not tag:  # Each pass from here on would parse every payload again; sequences stay where their rows lie.
        records = stage(records, always=True)
    many = map_width is not None and _distinct_names(records, F.col("__record")) > map_width
    if many and tag:
        records, moved = stage(records, always=True), True
    flat = flatten_records(records, keep=[*keep, *place], map_width=map_width if many else None, arrange=(
        lambda shape: _in_document_order(staged, column, shape, seq)) if document_order else lambda shape: shape)
    if tag:
        flat = tag_in_order(flat, place, moved)
    return normalize_columns(flat)
