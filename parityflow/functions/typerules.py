"""How the native column types of seven engines correspond.

Canonical kinds: Boolean TinyInt SmallInt Int BigInt Float Double Decimal Char
Varchar Text NChar NVarchar NText Binary Varbinary Blob Date Time DateTime
Timestamp Uuid Json Xml Unknown, plus a nesting depth for arrays.
"""

from __future__ import annotations

MAX = 4_294_967_295  # stands for "(max)"

# -- Fixed values: native name -> canonical kind ------------------------------
# Columns: engine, native name, kind, fixed p, fixed s, default p, default s.  A fixed parameter
# holds whatever the type carries, a default where it carries none.  BinaryBits and VarbinaryBits
# count their parameter in bits; UnknownBase keeps the native name, UnknownNull is "null".
_NATIVE = [
    ("SqlServer", "bit", "Boolean", None, None, None, None),
    ("SqlServer", "tinyint", "TinyInt", None, None, None, None),
    ("SqlServer", "smallint", "SmallInt", None, None, None, None),
    ("SqlServer", "int", "Int", None, None, None, None),
    ("SqlServer", "bigint", "BigInt", None, None, None, None),
    ("SqlServer", "real", "Float", None, None, None, None),
    ("SqlServer", "float", "Double", None, None, None, None),
    ("SqlServer", "decimal", "Decimal", None, None, 18, 0),
    ("SqlServer", "numeric", "Decimal", None, None, 18, 0),
    ("SqlServer", "money", "Decimal", 19, 4, None, None),
    ("SqlServer", "smallmoney", "Decimal", 10, 4, None, None),
    ("SqlServer", "char", "Char", None, None, 1, None),
    ("SqlServer", "varchar", "Varchar", None, None, 1, None),
    ("SqlServer", "text", "Text", None, None, None, None),
    ("SqlServer", "nchar", "NChar", None, None, 1, None),
    ("SqlServer", "nvarchar", "NVarchar", None, None, 1, None),
    ("SqlServer", "ntext", "NText", None, None, None, None),
    ("SqlServer", "binary", "Binary", None, None, 1, None),
    ("SqlServer", "varbinary", "Varbinary", None, None, 1, None),
    ("SqlServer", "timestamp", "Varbinary", 8, None, None, None),
    ("SqlServer", "rowversion", "Varbinary", 8, None, None, None),
    ("SqlServer", "image", "Blob", None, None, None, None),
    ("SqlServer", "date", "Date", None, None, None, None),
    ("SqlServer", "time", "Time", None, None, None, None),
    ("SqlServer", "datetime", "DateTime", None, None, None, None),
    ("SqlServer", "datetime2", "DateTime", None, None, None, None),
    ("SqlServer", "smalldatetime", "DateTime", None, None, None, None),
    ("SqlServer", "datetimeoffset", "Timestamp", None, None, None, None),
    ("SqlServer", "uniqueidentifier", "Uuid", None, None, None, None),
    ("SqlServer", "xml", "Xml", None, None, None, None),
    ("SqlServer", "sql_variant", "UnknownBase", None, None, None, None),
    ("SqlServer", "geography", "UnknownBase", None, None, None, None),
    ("SqlServer", "geometry", "UnknownBase", None, None, None, None),
    ("SqlServer", "hierarchyid", "UnknownBase", None, None, None, None),
    ("PostgreSql", "boolean", "Boolean", None, None, None, None),
    ("PostgreSql", "bool", "Boolean", None, None, None, None),
    ("PostgreSql", "smallint", "SmallInt", None, None, None, None),
    ("PostgreSql", "int2", "SmallInt", None, None, None, None),
    ("PostgreSql", "smallserial", "SmallInt", None, None, None, None),
    ("PostgreSql", "integer", "Int", None, None, None, None),
    ("PostgreSql", "int4", "Int", None, None, None, None),
    ("PostgreSql", "int", "Int", None, None, None, None),
    ("PostgreSql", "serial", "Int", None, None, None, None),
    ("PostgreSql", "bigint", "BigInt", None, None, None, None),
    ("PostgreSql", "int8", "BigInt", None, None, None, None),
    ("PostgreSql", "bigserial", "BigInt", None, None, None, None),
    ("PostgreSql", "real", "Float", None, None, None, None),
    ("PostgreSql", "float4", "Float", None, None, None, None),
    ("PostgreSql", "double precision", "Double", None, None, None, None),
    ("PostgreSql", "float8", "Double", None, None, None, None),
    ("PostgreSql", "numeric", "Decimal", None, None, 18, 0),
    ("PostgreSql", "decimal", "Decimal", None, None, 18, 0),
    ("PostgreSql", "money", "Decimal", 19, 4, None, None),
    ("PostgreSql", "char", "Char", None, None, 1, None),
    ("PostgreSql", "character", "Char", None, None, 1, None),
    ("PostgreSql", "varchar", "Varchar", None, None, 255, None),
    ("PostgreSql", "character varying", "Varchar", None, None, 255, None),
    ("PostgreSql", "cidr", "Varchar", 43, None, None, None),
    ("PostgreSql", "inet", "Varchar", 43, None, None, None),
    ("PostgreSql", "macaddr", "Varchar", 17, None, None, None),
    ("PostgreSql", "macaddr8", "Varchar", 17, None, None, None),
    ("PostgreSql", "text", "Text", None, None, None, None),
    ("PostgreSql", "interval", "Text", None, None, None, None),
    ("PostgreSql", "tsvector", "Text", None, None, None, None),
    ("PostgreSql", "tsquery", "Text", None, None, None, None),
    ("PostgreSql", "bytea", "Blob", None, None, None, None),
    ("PostgreSql", "date", "Date", None, None, None, None),
    ("PostgreSql", "time", "Time", None, None, None, None),
    ("PostgreSql", "time without time zone", "Time", None, None, None, None),
    ("PostgreSql", "timestamp", "DateTime", None, None, None, None),
    ("PostgreSql", "timestamp without time zone", "DateTime", None, None, None, None),
    ("PostgreSql", "timestamp with time zone", "Timestamp", None, None, None, None),
    ("PostgreSql", "timestamptz", "Timestamp", None, None, None, None),
    ("PostgreSql", "uuid", "Uuid", None, None, None, None),
    ("PostgreSql", "json", "Json", None, None, None, None),
    ("PostgreSql", "jsonb", "Json", None, None, None, None),
    ("PostgreSql", "xml", "Xml", None, None, None, None),
    ("PostgreSql", "bit", "BinaryBits", None, None, None, None),
    ("PostgreSql", "bit varying", "VarbinaryBits", None, None, None, None),
    ("PostgreSql", "varbit", "VarbinaryBits", None, None, None, None),
    ("PostgreSql", "point", "UnknownBase", None, None, None, None),
    ("PostgreSql", "line", "UnknownBase", None, None, None, None),
    ("PostgreSql", "lseg", "UnknownBase", None, None, None, None),
    ("PostgreSql", "box", "UnknownBase", None, None, None, None),
    ("PostgreSql", "path", "UnknownBase", None, None, None, None),
    ("PostgreSql", "polygon", "UnknownBase", None, None, None, None),
    ("PostgreSql", "circle", "UnknownBase", None, None, None, None),
    ("MySql", "boolean", "Boolean", None, None, None, None),
    ("MySql", "bool", "Boolean", None, None, None, None),
    ("MySql", "tinyint", "TinyInt", None, None, None, None),
    ("MySql", "smallint", "SmallInt", None, None, None, None),
    ("MySql", "year", "SmallInt", None, None, None, None),
    ("MySql", "mediumint", "Int", None, None, None, None),
    ("MySql", "int", "Int", None, None, None, None),
    ("MySql", "integer", "Int", None, None, None, None),
    ("MySql", "bigint", "BigInt", None, None, None, None),
    ("MySql", "float", "Float", None, None, None, None),
    ("MySql", "double", "Double", None, None, None, None),
    ("MySql", "double precision", "Double", None, None, None, None),
    ("MySql", "decimal", "Decimal", None, None, 10, 0),
    ("MySql", "numeric", "Decimal", None, None, 10, 0),
    ("MySql", "dec", "Decimal", None, None, 10, 0),
    ("MySql", "fixed", "Decimal", None, None, 10, 0),
    ("MySql", "char", "Char", None, None, 1, None),
    ("MySql", "varchar", "Varchar", None, None, 255, None),
    ("MySql", "tinytext", "Varchar", 255, None, None, None),
    ("MySql", "enum", "Varchar", 255, None, None, None),
    ("MySql", "set", "Varchar", 255, None, None, None),
    ("MySql", "text", "Text", None, None, None, None),
    ("MySql", "mediumtext", "Text", None, None, None, None),
    ("MySql", "longtext", "Text", None, None, None, None),
    ("MySql", "binary", "Binary", None, None, 1, None),
    ("MySql", "varbinary", "Varbinary", None, None, 1, None),
    ("MySql", "tinyblob", "Varbinary", 255, None, None, None),
    ("MySql", "blob", "Blob", None, None, None, None),
    ("MySql", "mediumblob", "Blob", None, None, None, None),
    ("MySql", "longblob", "Blob", None, None, None, None),
    ("MySql", "date", "Date", None, None, None, None),
    ("MySql", "time", "Time", None, None, None, None),
    ("MySql", "datetime", "DateTime", None, None, None, None),
    ("MySql", "timestamp", "Timestamp", None, None, None, None),
    ("MySql", "json", "Json", None, None, None, None),
    ("MySql", "bit", "BinaryBits", None, None, None, None),
    ("MySql", "geometry", "UnknownBase", None, None, None, None),
    ("MySql", "point", "UnknownBase", None, None, None, None),
    ("MySql", "linestring", "UnknownBase", None, None, None, None),
    ("MySql", "polygon", "UnknownBase", None, None, None, None),
    ("MySql", "multipoint", "UnknownBase", None, None, None, None),
    ("MySql", "multilinestring", "UnknownBase", None, None, None, None),
    ("MySql", "multipolygon", "UnknownBase", None, None, None, None),
    ("MySql", "geometrycollection", "UnknownBase", None, None, None, None),
    ("Oracle", "binary_float", "Float", None, None, None, None),
    ("Oracle", "binary_double", "Double", None, None, None, None),
    ("Oracle", "float", "Double", None, None, None, None),
    ("Oracle", "char", "Char", None, None, 1, None),
    ("Oracle", "varchar2", "Varchar", None, None, 1, None),
    ("Oracle", "rowid", "Varchar", 18, None, None, None),
    ("Oracle", "urowid", "Varchar", 18, None, None, None),
    ("Oracle", "nchar", "NChar", None, None, 1, None),
    ("Oracle", "nvarchar2", "NVarchar", None, None, 1, None),
    ("Oracle", "clob", "Text", None, None, None, None),
    ("Oracle", "long", "Text", None, None, None, None),
    ("Oracle", "interval year to month", "Text", None, None, None, None),
    ("Oracle", "interval day to second", "Text", None, None, None, None),
    ("Oracle", "nclob", "NText", None, None, None, None),
    ("Oracle", "raw", "Varbinary", None, None, 1, None),
    ("Oracle", "long raw", "Blob", None, None, None, None),
    ("Oracle", "blob", "Blob", None, None, None, None),
    ("Oracle", "bfile", "Blob", None, None, None, None),
    ("Oracle", "date", "DateTime", None, None, None, None),
    ("Oracle", "timestamp", "Timestamp", None, None, None, None),
    ("Oracle", "timestamp with time zone", "Timestamp", None, None, None, None),
    ("Oracle", "timestamp with local time zone", "Timestamp", None, None, None, None),
    ("Oracle", "xmltype", "Xml", None, None, None, None),
    ("MongoDb", "bool", "Boolean", None, None, None, None),
    ("MongoDb", "int", "Int", None, None, None, None),
    ("MongoDb", "int32", "Int", None, None, None, None),
    ("MongoDb", "long", "BigInt", None, None, None, None),
    ("MongoDb", "int64", "BigInt", None, None, None, None),
    ("MongoDb", "double", "Double", None, None, None, None),
    ("MongoDb", "decimal128", "Decimal", 34, 6, None, None),
    ("MongoDb", "decimal", "Decimal", 34, 6, None, None),
    ("MongoDb", "string", "Text", None, None, None, None),
    ("MongoDb", "javascript", "Text", None, None, None, None),
    ("MongoDb", "javascriptwithscope", "Text", None, None, None, None),
    ("MongoDb", "date", "DateTime", None, None, None, None),
    ("MongoDb", "timestamp", "Timestamp", None, None, None, None),
    ("MongoDb", "objectid", "Varchar", 24, None, None, None),
    ("MongoDb", "regex", "Varchar", 255, None, None, None),
    ("MongoDb", "bindata", "Blob", None, None, None, None),
    ("MongoDb", "object", "Json", None, None, None, None),
    ("MongoDb", "array", "Json", None, None, None, None),
    ("MongoDb", "null", "UnknownNull", None, None, None, None),
    ("MongoDb", "undefined", "UnknownNull", None, None, None, None),
    ("CosmosDb", "boolean", "Boolean", None, None, None, None),
    ("CosmosDb", "number", "Double", None, None, None, None),
    ("CosmosDb", "string", "Text", None, None, None, None),
    ("CosmosDb", "array", "Json", None, None, None, None),
    ("CosmosDb", "object", "Json", None, None, None, None),
    ("CosmosDb", "null", "UnknownNull", None, None, None, None),
]

# Where SQLite's affinity rules look, in this order.
SQLITE_EXACT = {"boolean": "Boolean", "bool": "Boolean", "blob": "Blob", "": "Blob"}
SQLITE_CONTAINS = (
    ("int", "BigInt"), ("char", "Text"), ("clob", "Text"), ("text", "Text"), ("blob", "Blob"),
    ("real", "Double"), ("floa", "Double"), ("doub", "Double"),
)
SQLITE_OTHER = "Double"

# -- Fixed values: canonical kind -> native text --------------------------------
# Columns: engine, kind, template.  {p} and {s} are the first and second parameter.
_RENDER = [
    ("SqlServer", "SmallInt", "SMALLINT"),
    ("SqlServer", "Int", "INT"),
    ("SqlServer", "BigInt", "BIGINT"),
    ("SqlServer", "Decimal", "DECIMAL({p},{s})"),
    ("SqlServer", "Char", "CHAR({p})"),
    ("SqlServer", "Varchar", "VARCHAR({p})"),
    ("SqlServer", "Binary", "BINARY({p})"),
    ("SqlServer", "Varbinary", "VARBINARY({p})"),
    ("SqlServer", "Date", "DATE"),
    ("SqlServer", "Time", "TIME"),
    ("SqlServer", "Xml", "XML"),
    ("SqlServer", "Boolean", "BIT"),
    ("SqlServer", "TinyInt", "TINYINT"),
    ("SqlServer", "Float", "REAL"),
    ("SqlServer", "Double", "FLOAT"),
    ("SqlServer", "Text", "VARCHAR(MAX)"),
    ("SqlServer", "NChar", "NCHAR({p})"),
    ("SqlServer", "NVarchar", "NVARCHAR({p})"),
    ("SqlServer", "NText", "NVARCHAR(MAX)"),
    ("SqlServer", "Blob", "VARBINARY(MAX)"),
    ("SqlServer", "DateTime", "DATETIME2"),
    ("SqlServer", "Timestamp", "DATETIMEOFFSET"),
    ("SqlServer", "Uuid", "UNIQUEIDENTIFIER"),
    ("SqlServer", "Json", "NVARCHAR(MAX)"),
    ("SqlServer", "Array", "NVARCHAR(MAX)"),
    ("PostgreSql", "SmallInt", "SMALLINT"),
    ("PostgreSql", "Int", "INTEGER"),
    ("PostgreSql", "BigInt", "BIGINT"),
    ("PostgreSql", "Decimal", "NUMERIC({p},{s})"),
    ("PostgreSql", "Char", "CHAR({p})"),
    ("PostgreSql", "Varchar", "VARCHAR({p})"),
    ("PostgreSql", "Binary", "BYTEA"),
    ("PostgreSql", "Varbinary", "BYTEA"),
    ("PostgreSql", "Date", "DATE"),
    ("PostgreSql", "Time", "TIME"),
    ("PostgreSql", "Xml", "XML"),
    ("PostgreSql", "Boolean", "BOOLEAN"),
    ("PostgreSql", "TinyInt", "SMALLINT"),
    ("PostgreSql", "Float", "REAL"),
    ("PostgreSql", "Double", "DOUBLE PRECISION"),
    ("PostgreSql", "Text", "TEXT"),
    ("PostgreSql", "NChar", "CHAR({p})"),
    ("PostgreSql", "NVarchar", "VARCHAR({p})"),
    ("PostgreSql", "NText", "TEXT"),
    ("PostgreSql", "Blob", "BYTEA"),
    ("PostgreSql", "DateTime", "TIMESTAMP"),
    ("PostgreSql", "Timestamp", "TIMESTAMPTZ"),
    ("PostgreSql", "Uuid", "UUID"),
    ("PostgreSql", "Json", "JSONB"),
    ("MySql", "SmallInt", "SMALLINT"),
    ("MySql", "Int", "INT"),
    ("MySql", "BigInt", "BIGINT"),
    ("MySql", "Decimal", "DECIMAL({p},{s})"),
    ("MySql", "Char", "CHAR({p})"),
    ("MySql", "Varchar", "VARCHAR({p})"),
    ("MySql", "Binary", "BINARY({p})"),
    ("MySql", "Varbinary", "VARBINARY({p})"),
    ("MySql", "Date", "DATE"),
    ("MySql", "Time", "TIME"),
    ("MySql", "Xml", "LONGTEXT"),
    ("MySql", "Boolean", "TINYINT(1)"),
    ("MySql", "TinyInt", "TINYINT"),
    ("MySql", "Float", "FLOAT"),
    ("MySql", "Double", "DOUBLE"),
    ("MySql", "Text", "LONGTEXT"),
    ("MySql", "NChar", "CHAR({p})"),
    ("MySql", "NVarchar", "VARCHAR({p})"),
    ("MySql", "NText", "LONGTEXT"),
    ("MySql", "Blob", "LONGBLOB"),
    ("MySql", "DateTime", "DATETIME"),
    ("MySql", "Timestamp", "TIMESTAMP"),
    ("MySql", "Uuid", "CHAR(36)"),
    ("MySql", "Json", "JSON"),
    ("MySql", "Array", "JSON"),
    ("Oracle", "SmallInt", "NUMBER(5)"),
    ("Oracle", "Int", "NUMBER(10)"),
    ("Oracle", "BigInt", "NUMBER(19)"),
    ("Oracle", "Decimal", "NUMBER({p},{s})"),
    ("Oracle", "Char", "CHAR({p})"),
    ("Oracle", "Varchar", "VARCHAR2({p})"),
    ("Oracle", "Binary", "RAW({p})"),
    ("Oracle", "Varbinary", "RAW({p})"),
    ("Oracle", "Date", "DATE"),
    ("Oracle", "Time", "TIMESTAMP"),
    ("Oracle", "Xml", "XMLTYPE"),
    ("Oracle", "Boolean", "NUMBER(1)"),
    ("Oracle", "TinyInt", "NUMBER(3)"),
    ("Oracle", "Float", "BINARY_FLOAT"),
    ("Oracle", "Double", "BINARY_DOUBLE"),
    ("Oracle", "Text", "CLOB"),
    ("Oracle", "NChar", "NCHAR({p})"),
    ("Oracle", "NVarchar", "NVARCHAR2({p})"),
    ("Oracle", "NText", "NCLOB"),
    ("Oracle", "Blob", "BLOB"),
    ("Oracle", "DateTime", "TIMESTAMP"),
    ("Oracle", "Timestamp", "TIMESTAMP WITH TIME ZONE"),
    ("Oracle", "Uuid", "RAW(16)"),
    ("Oracle", "Json", "CLOB"),
    ("Oracle", "Array", "CLOB"),
    ("Sqlite", "Boolean", "INTEGER"),
    ("Sqlite", "TinyInt", "INTEGER"),
    ("Sqlite", "SmallInt", "INTEGER"),
    ("Sqlite", "Int", "INTEGER"),
    ("Sqlite", "BigInt", "INTEGER"),
    ("Sqlite", "Float", "REAL"),
    ("Sqlite", "Double", "REAL"),
    ("Sqlite", "Decimal", "REAL"),
    ("Sqlite", "Char", "TEXT"),
    ("Sqlite", "Varchar", "TEXT"),
    ("Sqlite", "Text", "TEXT"),
    ("Sqlite", "NChar", "TEXT"),
    ("Sqlite", "NVarchar", "TEXT"),
    ("Sqlite", "NText", "TEXT"),
    ("Sqlite", "Uuid", "TEXT"),
    ("Sqlite", "Xml", "TEXT"),
    ("Sqlite", "Binary", "BLOB"),
    ("Sqlite", "Varbinary", "BLOB"),
    ("Sqlite", "Blob", "BLOB"),
    ("Sqlite", "Date", "TEXT"),
    ("Sqlite", "Time", "TEXT"),
    ("Sqlite", "DateTime", "TEXT"),
    ("Sqlite", "Timestamp", "TEXT"),
    ("Sqlite", "Json", "TEXT"),
    ("Sqlite", "Array", "TEXT"),
    ("MongoDb", "Boolean", "bool"),
    ("MongoDb", "TinyInt", "int"),
    ("MongoDb", "SmallInt", "int"),
    ("MongoDb", "Int", "int"),
    ("MongoDb", "BigInt", "long"),
    ("MongoDb", "Float", "double"),
    ("MongoDb", "Double", "double"),
    ("MongoDb", "Decimal", "decimal128"),
    ("MongoDb", "Char", "string"),
    ("MongoDb", "Varchar", "string"),
    ("MongoDb", "Text", "string"),
    ("MongoDb", "NChar", "string"),
    ("MongoDb", "NVarchar", "string"),
    ("MongoDb", "NText", "string"),
    ("MongoDb", "Uuid", "string"),
    ("MongoDb", "Xml", "string"),
    ("MongoDb", "Binary", "binData"),
    ("MongoDb", "Varbinary", "binData"),
    ("MongoDb", "Blob", "binData"),
    ("MongoDb", "Date", "date"),
    ("MongoDb", "Time", "date"),
    ("MongoDb", "DateTime", "date"),
    ("MongoDb", "Timestamp", "date"),
    ("MongoDb", "Json", "object"),
    ("MongoDb", "Array", "array"),
    ("CosmosDb", "Boolean", "boolean"),
    ("CosmosDb", "TinyInt", "number"),
    ("CosmosDb", "SmallInt", "number"),
    ("CosmosDb", "Int", "number"),
    ("CosmosDb", "BigInt", "number"),
    ("CosmosDb", "Float", "number"),
    ("CosmosDb", "Double", "number"),
    ("CosmosDb", "Decimal", "number"),
    ("CosmosDb", "Char", "string"),
    ("CosmosDb", "Varchar", "string"),
    ("CosmosDb", "Text", "string"),
    ("CosmosDb", "NChar", "string"),
    ("CosmosDb", "NVarchar", "string"),
    ("CosmosDb", "NText", "string"),
    ("CosmosDb", "Uuid", "string"),
    ("CosmosDb", "Xml", "string"),
    ("CosmosDb", "Binary", "string"),
    ("CosmosDb", "Varbinary", "string"),
    ("CosmosDb", "Blob", "string"),
    ("CosmosDb", "Date", "string"),
    ("CosmosDb", "Time", "string"),
    ("CosmosDb", "DateTime", "string"),
    ("CosmosDb", "Timestamp", "string"),
    ("CosmosDb", "Json", "object"),
    ("CosmosDb", "Array", "array"),
]
# Engines that write an unknown type as it is; the others write it in capitals.
KEEPS_UNKNOWN = ("MongoDb", "CosmosDb")


def native_rules() -> list[tuple]:
    """Rows ``engine, base, kind, fixed_p, fixed_s, default_p, default_s``."""
    return list(_NATIVE)


def render_rules() -> list[tuple]:
    """Rows ``engine, kind, template``."""
    return list(_RENDER)
