"""The vulnerability types: seeds, filter chains, keys, tiers."""

from __future__ import annotations

from dataclasses import dataclass, field

# Filter chains by name, and the types with their CWE numbers, seeds and categories.
NULL_CHAIN = ("sizeof_pseudo_deref", "non_nullable_array_suppress", "array_oob_precedence", "nullable_source", "call_reach", "guard", "safe_function_exclude")
DEFAULT_CHAIN = ("call_reach", "safe_function_exclude")
CHAINS: dict[str, tuple[str, ...]] = {
    "null-deref": NULL_CHAIN,
    "memory-leak": (*DEFAULT_CHAIN, "memory_release", "ownership_transfer"),
    "resource-leak": (*DEFAULT_CHAIN, "resource_release", "ownership_transfer"),
    "lifetime": (*DEFAULT_CHAIN, "lifetime"),
    "uninit": ("call_reach", "definite_init", "safe_function_exclude"),
    "double-free": (*DEFAULT_CHAIN, "double_free_flow"),
    "injection": (*DEFAULT_CHAIN, "taint_source"),
    "path-traversal": (*DEFAULT_CHAIN, "taint_source"),
    "format-string": (*DEFAULT_CHAIN, "taint_source"),
    "integer-overflow": (*DEFAULT_CHAIN, "int_overflow_guard"),
    "divide-by-zero": (*DEFAULT_CHAIN, "range"),
    "deadlock": (*DEFAULT_CHAIN, "lock_order"),
    "race-condition": (*DEFAULT_CHAIN, "shared_access"),
    "default": DEFAULT_CHAIN,
}

BY_VARIABLE, BY_LINE = ("path", "function", "variable"), ("path", "line", "function", "variable")


@dataclass(frozen=True)
class VulnType:
    name: str
    cwe: int
    seed: str
    suspicion: str = "suspected"
    chain: str = "default"
    key: tuple[str, ...] = BY_LINE
    categories: tuple[str, ...] = ()
    tiers: dict[str, str] = field(default_factory=dict, hash=False)
    legacy: tuple[int, ...] = ()

    @property
    def filters(self) -> tuple[str, ...]:
        return CHAINS[self.chain]


OVERFLOWS = {
    "buffer_overflow": "suspected", "array_oob_write": "confirmed", "heap_oob_write": "confirmed", "sprintf_overflow": "suspected",
    "bounded_copy_overflow": "confirmed", "bounded_copy_var_size": "possible", "secure_copy_overflow": "confirmed", "secure_copy_var_size": "possible",
    "secure_constraint_violation": "suspected", "secure_scanf_overflow": "confirmed", "secure_scanf_var_size": "possible",
}

TYPES: dict[str, VulnType] = {
    t.name: t
    for t in (
        VulnType("null-deref", 476, "DEREFERENCE", "confirmed", "null-deref", BY_VARIABLE),
        VulnType("buffer-overflow", 787, "BUFFER_ACCESS", categories=tuple(OVERFLOWS), tiers=OVERFLOWS),
        VulnType("memory-leak", 401, "MEMORY_ALLOC", chain="memory-leak"),
        VulnType("injection", 78, "INJECTION", chain="injection", key=("path", "function", "category", "variable"), legacy=(89,)),
        VulnType("resource-leak", 404, "RESOURCE_ACQUIRE", chain="resource-leak"),
        VulnType("uninit", 457, "VALUE_USE", chain="uninit"),
        VulnType("use-after-free", 416, "USE_AFTER_FREE", chain="lifetime", key=BY_VARIABLE),
        VulnType("double-free", 415, "DOUBLE_FREE", chain="double-free", key=BY_VARIABLE),
        VulnType("format-string", 134, "FORMAT_STRING", chain="format-string"),
        VulnType("integer-overflow", 190, "INTEGER_OVERFLOW", chain="integer-overflow", key=("path", "function", "line"), tiers={"size_calc": "suspected", "size_mul_const": "suspected", "size_add": "possible", "size_sub": "possible", "integer_overflow": "possible"}),
        VulnType("race-condition", 362, "RACE_CONDITION", chain="race-condition"),
        VulnType("hardcoded-secret", 798, "HARDCODED_SECRET", "confirmed"),
        VulnType("deadlock", 667, "DEADLOCK", chain="deadlock"),
        VulnType("crypto-misuse", 327, "CRYPTO_MISUSE", key=("path", "function", "category"), tiers={"weak_algorithm": "confirmed", "undersized_key": "confirmed", "weak_random": "suspected"}, legacy=(326, 338)),
        VulnType("out-of-bounds", 125, "BUFFER_ACCESS", categories=("array_oob_read", "heap_oob_read"), tiers={"array_oob_read": "confirmed", "heap_oob_read": "confirmed"}),
        VulnType("divide-by-zero", 369, "DIVIDE_BY_ZERO", chain="divide-by-zero"),
        VulnType("unchecked-return", 252, "UNCHECKED_RETURN"),
        VulnType("path-traversal", 22, "PATH_TRAVERSAL", chain="path-traversal"),
        VulnType("sizeof-misuse", 467, "SIZEOF_MISUSE"),
        VulnType("signed-compare", 681, "SIGNED_COMPARE"),
    )
}

#: The detectors that a type of event comes from.
SOURCES: dict[str, tuple[str, ...]] = {
    "NULL_VALUE": ("null_source",), "DEREFERENCE": ("dereference", "null_source", "param_deref"), "NULL_GUARD": ("null_guard",), "BUFFER_ACCESS": ("buffer_overflow",), "MEMORY_ALLOC": ("memory_leak",), "MEMORY_RELEASE": ("memory_leak",), "INJECTION": ("injection",),
    "RESOURCE_ACQUIRE": ("resource_leak",), "RESOURCE_RELEASE": ("resource_leak",), "VALUE_USE": ("uninit_variable",), "USE_AFTER_FREE": ("use_after_free",), "DOUBLE_FREE": ("double_free",), "FORMAT_STRING": ("format_string",), "INTEGER_OVERFLOW": ("integer_overflow",),
    "RACE_CONDITION": ("race_condition",), "HARDCODED_SECRET": ("hardcoded_secret",), "DEADLOCK": ("lock_order",), "LOCK_ORDER": ("lock_order",), "CRYPTO_MISUSE": ("crypto_misuse",), "DIVIDE_BY_ZERO": ("divide_by_zero",), "UNCHECKED_RETURN": ("unchecked_return",),
    "PATH_TRAVERSAL": ("path_traversal",), "SIZEOF_MISUSE": ("sizeof_misuse",), "SIGNED_COMPARE": ("signed_compare",),
    "PARAM_DEREF": ("param_deref",), "ARGUMENT": ("param_deref",),
}


# Evidence: the fragment of each type, its role, and what it says.
FRAGMENTS: dict[str, tuple[str, str, str]] = {
    "null-deref": ("dereference", "sink", "{variable} is followed at line {line}"),
    "buffer-overflow": ("buffer_access", "sink", "{function} writes to a buffer at line {line}"),
    "memory-leak": ("memory_alloc", "source", "{function} allocates at line {line}"),
    "injection": ("unsafe_call", "sink", "{function} passes text to an interpreter at line {line}"),
    "resource-leak": ("resource_acquire", "source", "{function} acquires a resource at line {line}"),
    "uninit": ("uninit_use", "sink", "{function} uses {variable} before it has a value, at line {line}"),
    "use-after-free": ("use_after_free", "sink", "{function} uses {variable} after it is freed, at line {line}"),
    "double-free": ("double_free", "sink", "{function} frees {variable} again at line {line}"),
    "format-string": ("format_string", "sink", "{function} formats by a text that is no literal, at line {line}"),
    "integer-overflow": ("integer_overflow", "sink", "a size in {function} can overflow at line {line}"),
    "race-condition": ("data_race", "sink", "{function} uses shared {variable} without a common lock, at line {line}"),
    "hardcoded-secret": ("hardcoded_secret", "sink", "{function} holds a secret at line {line}"),
    "deadlock": ("deadlock", "sink", "{function} takes locks in a circle at line {line}"),
    "crypto-misuse": ("crypto_misuse", "sink", "{function} uses weak cryptography at line {line}"),
    "out-of-bounds": ("out_of_bounds", "sink", "{function} reads past a bound at line {line}"),
    "divide-by-zero": ("divide_by_zero", "sink", "{function} may divide by zero at line {line}"),
    "unchecked-return": ("unchecked_return", "sink", "{function} doesn't test the result of {api} at line {line}"),
    "path-traversal": ("path_traversal", "sink", "{api} takes a path that is no literal, at line {line}"),
    "sizeof-misuse": ("sizeof_misuse", "sink", "{function} takes the size of the pointer {variable} at line {line}"),
    "signed-compare": ("signed_compare", "sink", "{function} compares an unsigned value with zero or less at line {line}"),
}
TOCTOU = "{function} tests a path and uses it later, from line {line}"
DEFINITE_NULL = "{variable} is null on every way to line {line}"
NULLABLE = "{variable} may have become null before line {line}"
#: Types that say nothing of the way to them, and those that may have a source outside the program.
NO_WAY, TAINTED = ("hardcoded-secret", "deadlock"), ("injection", "format-string", "path-traversal")


def type_of_cwe(cwe: str) -> str | None:
    """The type of CWE-n or n, legacy numbers too."""
    n = int(str(cwe).upper().removeprefix("CWE-"))
    return next((t.name for t in TYPES.values() if n == t.cwe or n in t.legacy), None)


def known_cwes() -> set[str]:
    return {f"CWE-{n}" for t in TYPES.values() for n in (t.cwe, *t.legacy)}
