"""Small ONNX graphs for ONNX Runtime. They are written as protocol buffers here: the onnx package,
which has classes for them, need not be there."""

from __future__ import annotations

import numpy as np
import onnxruntime

_FLOAT, _LONG = 1, 7
_KINDS = {np.dtype(np.float32): _FLOAT, np.dtype(np.int64): _LONG}


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(no: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(no << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(no << 3 | 2) + _number(len(value)) + value


def _fields(no: int, values: list) -> bytes:
    return b"".join(_field(no, v) for v in values)


def tensor(name: str, values: np.ndarray) -> bytes:
    """A constant of a graph (floats of 32 bits or integers of 64)."""
    values = np.ascontiguousarray(values)
    return _fields(1, list(values.shape)) + _field(2, _KINDS[values.dtype]) + _field(8, name) + _field(9, values.tobytes())


def _attribute(name: str, value: int | list[int] | bytes) -> bytes:
    if isinstance(value, int):
        return _field(1, name) + _field(3, value) + _field(20, 2)
    if isinstance(value, list):
        return _field(1, name) + _fields(8, value) + _field(20, 7)
    return _field(1, name) + _field(6, value) + _field(20, 5)  # a graph


def node(op: str, ins: str, outs: str, **attributes: int | list[int] | bytes) -> bytes:
    """An operation on values named in ``ins``, space-joined like ``outs``."""
    given = [_attribute(name, value) for name, value in attributes.items()]
    return _fields(1, ins.split()) + _fields(2, outs.split()) + _field(4, op) + _fields(5, given)


def graph(nodes: list[bytes], tensors: list[bytes], ins: dict[str, int], outs: dict[str, int]) -> bytes:
    """A graph; ``ins`` and ``outs`` have the number of axes by name; names that end in _ids are integers."""

    def shown(name: str, axes: int) -> bytes:
        kind = _field(1, _LONG if name.endswith("_ids") else _FLOAT)
        return _field(1, name) + _field(2, _field(1, kind + _field(2, _fields(1, [b""] * axes))))

    ends = _fields(11, [shown(*i) for i in ins.items()]) + _fields(12, [shown(*o) for o in outs.items()])
    return _fields(1, nodes) + _field(2, "graph") + _fields(5, tensors) + ends


def session(whole: bytes) -> onnxruntime.InferenceSession:
    """A graph ready to run, on one thread, the caller's."""
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.enable_mem_pattern = False  # sizes differ from run to run
    options.log_severity_level = 3
    model = _field(1, 8) + _field(7, whole) + _field(8, _field(2, 14))  # format 8, operations of version 14
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
