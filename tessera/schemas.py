"""Schemas of the relations that extraction yields."""

from pyspark.sql import types as T


_NAMED = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("alias", T.StringType())]))
_KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "strings": T.ArrayType(T.StringType()), "named": _NAMED}


def _s(spec: str) -> T.StructType:
    """Schema of 'name kind' pairs; needs no session, as parsing DDL would."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in spec.split(", "))])


FILES = _s("path string, content string")
IMPORTS = _s("file string, source string, import_kind string, default string, named named, namespace string, type_only boolean, side_effect boolean, line int")
FUNCTIONS = _s("file string, name string, kind string, async boolean, params strings, line int, exported boolean")
EXPORTS = _s("file string, name string, local_name string, kind string, type_only boolean, source string, line int")
CALLS = _s("file string, caller string, callee string, callee_object string, kind string, line int")
AST_HOOKS = _s("file string, name string, caller string, args_count int, line int")
AST_COMPONENTS = _s("file string, name string, kind string, props strings, exported boolean, line int")
TYPES = _s("file string, name string, kind string, exported boolean, members strings, line int")
AST = {"imports": IMPORTS, "functions": FUNCTIONS, "exports": EXPORTS, "calls": CALLS, "hooks": AST_HOOKS, "components": AST_COMPONENTS, "types": TYPES}
