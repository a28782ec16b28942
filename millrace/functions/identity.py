"""What a Python function or class is, as plain data that is the same in every session."""

from __future__ import annotations

import functools
import types
from typing import Any

_PLAIN = (str, int, float, bool, bytes, type(None))


def code_mark(thing: Any) -> Any:
    """Name, code, constants, defaults and what is closed over; it changes when the function's body does.

    Classes are told by their name and their methods' code, other objects by their class and plain attributes.
    """
    if isinstance(thing, _PLAIN):
        return repr(thing)
    if isinstance(thing, functools.partial):
        return ["partial", code_mark(thing.func), code_mark(thing.args), code_mark(thing.keywords)]
    if isinstance(thing, (list, tuple, set, frozenset)):
        found = [code_mark(x) for x in thing]
        return sorted(found, key=repr) if isinstance(thing, (set, frozenset)) else found
    if isinstance(thing, dict):
        return [[code_mark(k), code_mark(v)] for k, v in sorted(thing.items(), key=lambda p: repr(p[0]))]
    if isinstance(thing, types.CodeType):
        return [thing.co_code.hex(), list(thing.co_names), [code_mark(c) for c in thing.co_consts]]
    if isinstance(thing, types.MethodType):
        return [code_mark(thing.__func__), code_mark(thing.__self__)]
    if isinstance(thing, types.FunctionType):
        closed = [code_mark(c.cell_contents) for c in thing.__closure__ or () if not _is_itself(c, thing)]
        return [thing.__qualname__, code_mark(thing.__code__), code_mark(thing.__defaults__), code_mark(thing.__kwdefaults__), closed]
    if isinstance(thing, type):
        methods = {k: v for k, v in vars(thing).items() if isinstance(v, types.FunctionType) and v.__closure__ is None}
        return [f"{thing.__module__}.{thing.__qualname__}", {k: code_mark(v) for k, v in sorted(methods.items())}]
    plain = {k: repr(v) for k, v in sorted(getattr(thing, "__dict__", {}).items()) if isinstance(v, _PLAIN)}
    return [f"{type(thing).__module__}.{type(thing).__qualname__}", plain]


def _is_itself(cell: types.CellType, f: types.FunctionType) -> bool:
    try:
        return cell.cell_contents is f
    except ValueError:  # not filled yet
        return True
