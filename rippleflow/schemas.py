"""The data model as Spark types.

Unknown values are '' (base type, mvid, hash) or null (output directory, dll), as each column
says. Names compare without case through a lower-cased key column; fully qualified names,
hashes of members, node keys and display names compare and sort by their bytes.
"""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 4
#: A changed range that covers a whole file ends here.
WHOLE_FILE = 2147483647
#: Lifecycle scopes, narrow to wide.
SCOPE_NONE, SCOPE_FIXTURE, SCOPE_ASSEMBLY, SCOPE_GLOBAL = range(4)


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


METHOD_ENTRY = _struct("token:i fqn:s hash:s")
ASSEMBLY_ENTRY = T.StructType([*_struct("name:s mvid:s contentHash:s methodsAnalyzed:b").fields, T.StructField("methods", T.ArrayType(METHOD_ENTRY))])
CONTENT_ENTRY = _struct("name:s hash:s")
MANIFEST = T.StructType(
    [*_struct("version:i tfm:s scope:s").fields, T.StructField("assemblies", T.ArrayType(ASSEMBLY_ENTRY)), T.StructField("contentFiles", T.ArrayType(CONTENT_ENTRY))]
)

ASSEMBLY = _struct("name:s mvid:s content_hash:s methods_analyzed:b")
METHOD = _struct("assembly:s token:i fqn:s hash:s")
CONTENT_FILE = _struct("name:s hash:s")
CHANGED_RANGE = _struct("path:s start_line:i end_line:i")
EDGE = _struct("callee:s caller:s kind:s")
TEST = _struct("key:s display_name:s assembly:s declaring_type:s parameterized:b namespace:s class_name:s")
LIFECYCLE = _struct("method_key:s scope:i declaring_type:s assembly:s")
BASE_TYPE = _struct("type:s base:s")
TYPE_MEMBER = _struct("type:s member_key:s")
PROVIDER_REF = _struct("type:s member:s test_key:s")
SEQUENCE_POINT = _struct("assembly:s method_fqn:s document:s start_line:i end_line:i hidden:b")
METHOD_CHANGE = _struct("assembly:s fqn:s kind:s")
FRAMEWORK_PRESENT = _struct("assembly:s framework:s")

# Facts that decoding a build yields; one row per thing, by assembly.
TYPE_FACT = _struct("assembly:s type:s simple_name:s declaring_type:s base:s base_scope:s is_interface:b flags:i arity:i entry_point:s namespace:s")
MEMBER_FACT = _struct("assembly:s type:s name:s params:i fqn:s return_type:s is_static:b is_virtual:b is_ctor:b flags:i arity:i token:i")
INSTRUCTION_FACT = T.StructType([*_struct("assembly:s fqn:s").fields, T.StructField("offset", T.IntegerType()), *_struct("opcode:s operand_kind:s operand:s target_type:s target_name:s").fields, T.StructField("target_params", T.IntegerType()), *_struct("target_scope:s type_args:as").fields, T.StructField("jumps", T.ArrayType(T.IntegerType()))])
ATTRIBUTE_FACT = _struct("assembly:s owner_kind:s owner:s attribute:s args:as named:as type_args:as raw:s")
INTERFACE_FACT = _struct("assembly:s type:s interface:s interface_args:as")
OVERRIDE_FACT = _struct("assembly:s member_key:s overridden_key:s")
FIELD_FACT = _struct("assembly:s type:s name:s field_type:s flags:i constant:s")
ATTRIBUTE_BASE = _struct("attribute:s base:s")
MODULE_FACT = _struct("assembly:s order:i tfm:s mvid:s")
BODY_FACT = _struct("assembly:s fqn:s locals:s regions:s")
