"""Neuroimaging file formats to and from numpy, without other libraries: NIfTI-1/2, GIFTI, dense CIFTI-2."""

from __future__ import annotations

import base64
import gzip
import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass, field

import numpy as np

# fixed values: NIfTI data type codes
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
# fixed values: GIFTI data types
GIFTI_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8", "NIFTI_TYPE_INT64": "i8"}
# fixed values: CIFTI file extension by the kinds of its axes (rows, columns)
CIFTI_EXTENSIONS = {
    ("brain", "brain"): "dconn", ("parcels", "parcels"): "pconn", ("brain", "parcels"): "dpconn", ("parcels", "brain"): "pdconn",
    ("series", "brain"): "dtseries", ("series", "parcels"): "ptseries", ("scalar", "brain"): "dscalar", ("scalar", "parcels"): "pscalar",
    ("label", "brain"): "dlabel", ("label", "parcels"): "plabel", ("brain", "scalar"): "dfan",
}


def cifti_extension(*axes: str) -> str:
    """The extension of a CIFTI file with these kinds of axes."""
    return f".{CIFTI_EXTENSIONS.get(tuple(axes[:2]), 'cifti')}.nii"


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Scaled values (first axis fastest, as stored), the 4 x 4 affine and the bytes between header and data."""
    data = _plain(data)
    size = next((n for o in "<>" if (n := struct.unpack(f"{o}i", data[:4])[0]) in (348, 540)), 0)
    if not size:
        raise ValueError("not a NIfTI file")
    order = "<" if struct.unpack("<i", data[:4])[0] == size else ">"
    get = lambda fmt, at: struct.unpack_from(order + fmt, data, at)
    if size == 348:
        dim, code, offset, (slope, inter) = get("8h", 40), get("h", 70)[0], int(get("f", 108)[0]), get("2f", 112)
        rows = [get("4f", 280 + 16 * r) for r in range(3)]
        scales, has_rows = get("8f", 76), get("h", 254)[0] > 0
    else:
        dim, code, offset, (slope, inter) = get("8q", 16), get("h", 12)[0], get("q", 168)[0], get("2d", 176)
        rows = [get("4d", 400 + 32 * r) for r in range(3)]
        scales, has_rows = get("8d", 104), get("i", 348)[0] > 0
    shape = tuple(int(n) for n in dim[1 : 1 + dim[0]])
    values = np.frombuffer(data, order + NIFTI_TYPES[code], int(np.prod(shape)), offset).reshape(shape, order="F")
    affine = np.vstack([rows, [0, 0, 0, 1]]) if has_rows else np.diag([*(s or 1.0 for s in scales[1:4]), 1.0])
    if slope not in (0.0, 1.0) or (slope and inter):
        values = values * slope + inter
    return values, affine, data[size:offset]


def write_nifti(values: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """A NIfTI-1 file; booleans become bytes and 64-bit integers 32-bit."""
    values = values.astype("u1") if values.dtype == bool else values.astype("i4") if values.dtype.kind == "i" and values.dtype.itemsize == 8 else values
    code = next(c for c, t in NIFTI_TYPES.items() if np.dtype(t) == values.dtype.newbyteorder("="))
    affine = np.eye(4) if affine is None else np.asarray(affine, float)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, code, values.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 2)
    for r in range(3):
        struct.pack_into("<4f", head, 280 + 16 * r, *affine[r])
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype(values.dtype.newbyteorder("<")).tobytes(order="F")


@dataclass
class Gifti:
    """Arrays of a GIFTI file with their intents and metadata, and its label table (key -> name, rgba)."""

    arrays: list[np.ndarray]
    intents: list[str]
    meta: list[dict]
    labels: dict = field(default_factory=dict)

    def structure(self) -> str:
        """The anatomical structure that the file names; the last array's counts."""
        found = [m["AnatomicalStructurePrimary"] for m in self.meta if "AnatomicalStructurePrimary" in m]
        return found[-1] if found else "unknown"

    def mesh(self) -> tuple[np.ndarray, np.ndarray]:
        """Vertices and triangles; an error unless there is one of each."""
        parts = [[a for a, i in zip(self.arrays, self.intents, strict=True) if i == f"NIFTI_INTENT_{k}"] for k in ("POINTSET", "TRIANGLE")]
        if any(len(p) != 1 for p in parts):
            raise ValueError("a surface file has one array of points and one of triangles")
        return parts[0][0], parts[1][0]


def read_gifti(data: bytes) -> Gifti:
    root = ET.fromstring(_plain(data))
    out = Gifti([], [], [])
    for label in root.iter("Label"):
        out.labels[int(label.get("Key"))] = (label.text or "", tuple(float(label.get(c, 0)) for c in ("Red", "Green", "Blue", "Alpha")))
    common = {m.findtext("Name"): m.findtext("Value") for m in root.findall("MetaData/MD")}
    for node in root.findall("DataArray"):
        shape = tuple(int(node.get(f"Dim{k}")) for k in range(int(node.get("Dimensionality"))))
        kind, encoding, text = GIFTI_TYPES[node.get("DataType")], node.get("Encoding"), node.findtext("Data") or ""
        if encoding == "ASCII":
            flat = np.array(text.split(), dtype=kind)
        else:
            raw = base64.b64decode(text)
            raw = zlib.decompress(raw) if encoding.startswith("GZip") else raw
            flat = np.frombuffer(raw, ("<" if node.get("Endian") == "LittleEndian" else ">") + kind)
        out.arrays.append(flat.reshape(shape, order="C" if node.get("ArrayIndexingOrder", "RowMajorOrder") == "RowMajorOrder" else "F"))
        out.intents.append(node.get("Intent", "NIFTI_INTENT_NONE"))
        out.meta.append({**common, **{m.findtext("Name"): m.findtext("Value") for m in node.findall("MetaData/MD")}})
    return out


def write_gifti(arrays: list[np.ndarray], intents: list[str], structure: str | None = None, labels: dict | None = None) -> bytes:
    """A GIFTI file of arrays narrowed to bytes, 32-bit integers or floats, gzipped and in base64."""
    root = ET.Element("GIFTI", Version="1.0", NumberOfDataArrays=str(len(arrays)))
    table = ET.SubElement(root, "LabelTable")
    for key, (name, rgba) in (labels or {}).items():
        ET.SubElement(table, "Label", Key=str(key), **dict(zip(("Red", "Green", "Blue", "Alpha"), map(str, rgba), strict=True))).text = name
    for a, intent in zip(arrays, intents, strict=True):
        kind = "u1" if a.dtype in (bool, np.uint8) else "i4" if a.dtype.kind in "iu" else "f4"
        a = np.ascontiguousarray(a.astype(kind))
        name = next(n for n, t in GIFTI_TYPES.items() if t == kind)
        node = ET.SubElement(root, "DataArray", Intent=intent, DataType=name, ArrayIndexingOrder="RowMajorOrder", Dimensionality=str(a.ndim), Encoding="GZipBase64Binary", Endian="LittleEndian", **{f"Dim{k}": str(n) for k, n in enumerate(a.shape)})
        meta = ET.SubElement(node, "MetaData")
        if structure:
            md = ET.SubElement(meta, "MD")
            ET.SubElement(md, "Name").text, ET.SubElement(md, "Value").text = "AnatomicalStructurePrimary", structure
        ET.SubElement(node, "Data").text = base64.b64encode(zlib.compress(a.astype("<" + kind).tobytes())).decode()
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root)


def read_cifti(data: bytes) -> tuple[np.ndarray, dict[int, dict]]:
    """The matrix (rows, columns) of a CIFTI-2 file and, for each axis, a description.

    Brain models are {kind, elements: [(structure, vertex, i, j, k)]}; scalars and
    labels {kind, names, tables}; series {kind, start, step, unit, size}; parcels
    {kind, names, members}.
    """
    values, _, between = read_nifti(data)
    at, xml = 4, None
    while at + 8 <= len(between):
        size, code = struct.unpack_from("<2i", between, at)
        if code == 32:
            xml = between[at + 8 : at + size].rstrip(b"\0")
        at += max(size, 8)
    if xml is None:
        raise ValueError("no CIFTI extension")
    axes: dict[int, dict] = {}
    for node in ET.fromstring(xml).iter("MatrixIndicesMap"):
        axis = _cifti_axis(node)
        for dim in node.get("AppliesToMatrixDimension").split(","):
            axes[int(dim)] = axis
    matrix = values.reshape(values.shape[4:] if values.ndim > 4 else values.shape, order="F")
    # dimension 0 of the description runs along the rows' entries, which are stored fastest
    return matrix.T, {1 - d if matrix.ndim == 2 else d: a for d, a in axes.items()}


def _cifti_volume(node) -> dict:
    """Shape and affine of the voxel space that a map names."""
    volume = node.find("Volume")
    if volume is None:
        return {}
    matrix = [float(x) for x in volume.findtext("TransformationMatrixVoxelIndicesIJKtoXYZ").split()]
    return {"shape": [int(x) for x in volume.get("VolumeDimensions").split(",")], "affine": [matrix[k : k + 4] for k in range(0, 16, 4)]}


def _cifti_axis(node) -> dict:
    kind = node.get("IndicesMapToDataType").rsplit("_", 1)[-1].lower()
    numbers = lambda n: [int(x) for x in (n.text or "").split()] if n is not None else []
    if kind == "models":
        elements = []
        for m in sorted(node.findall("BrainModel"), key=lambda m: int(m.get("IndexOffset"))):
            name = m.get("BrainStructure")
            vertices, voxels = numbers(m.find("VertexIndices")), numbers(m.find("VoxelIndicesIJK"))
            elements += [(name, v, None, None, None) for v in vertices] or [(name, None, *voxels[k : k + 3]) for k in range(0, len(voxels), 3)]
        sizes = {m.get("BrainStructure"): int(m.get("SurfaceNumberOfVertices")) for m in node.findall("BrainModel") if m.get("SurfaceNumberOfVertices")}
        return {"kind": "brain", "elements": elements, **({"nvertices": sizes} if sizes else {}), **_cifti_volume(node)}
    if kind == "series":
        return {"kind": "series", "start": float(node.get("SeriesStart")), "step": float(node.get("SeriesStep")), "unit": node.get("SeriesUnit"), "size": int(node.get("NumberOfSeriesPoints"))}
    if kind == "parcels":
        parcels = node.findall("Parcel")
        return {"kind": "parcels", "names": [p.get("Name") for p in parcels], "members": [{v.get("BrainStructure"): numbers(v) for v in p.findall("Vertices")} for p in parcels]}
    maps = node.findall("NamedMap")
    tables = [{int(t.get("Key")): t.text or "" for t in m.iter("Label")} for m in maps]
    return {"kind": "label" if kind == "labels" else "scalar", "names": [m.findtext("MapName") for m in maps], "tables": tables}


def _axis_xml(axis: dict, dimensions: str) -> ET.Element:
    """The description of an axis (see ``read_cifti``) as XML."""
    kinds = {"brain": "BRAIN_MODELS", "series": "SERIES", "parcels": "PARCELS", "label": "LABELS", "scalar": "SCALARS"}
    node = ET.Element("MatrixIndicesMap", AppliesToMatrixDimension=dimensions, IndicesMapToDataType=f"CIFTI_INDEX_TYPE_{kinds[axis['kind']]}")
    text = lambda numbers: " ".join(str(int(x)) for x in numbers)
    if axis["kind"] == "brain":
        _volume_xml(node, axis)
        at, elements = 0, [tuple(e) for e in axis["elements"]]
        while at < len(elements):
            name, on_surface = elements[at][0], elements[at][1] is not None
            end = at
            while end < len(elements) and elements[end][0] == name and (elements[end][1] is not None) == on_surface:
                end += 1
            some = elements[at:end]
            kind = "CIFTI_MODEL_TYPE_SURFACE" if on_surface else "CIFTI_MODEL_TYPE_VOXELS"
            model = ET.SubElement(node, "BrainModel", IndexOffset=str(at), IndexCount=str(end - at), ModelType=kind, BrainStructure=name)
            if on_surface:
                model.set("SurfaceNumberOfVertices", str(axis.get("nvertices", {}).get(name, max(e[1] for e in some) + 1)))
                ET.SubElement(model, "VertexIndices").text = text(e[1] for e in some)
            else:
                ET.SubElement(model, "VoxelIndicesIJK").text = text(x for e in some for x in e[2:])
            at = end
    elif axis["kind"] == "series":
        node.attrib |= {"SeriesStart": str(axis["start"]), "SeriesStep": str(axis["step"]), "SeriesUnit": axis["unit"], "NumberOfSeriesPoints": str(axis["size"]), "SeriesExponent": "0"}
    elif axis["kind"] == "parcels":
        _volume_xml(node, axis)
        for name, members in zip(axis["names"], axis["members"], strict=True):
            parcel = ET.SubElement(node, "Parcel", Name=name)
            for structure, vertices in members.items():
                ET.SubElement(parcel, "Vertices", BrainStructure=structure).text = text(vertices)
    else:
        for name, table in zip(axis["names"], axis["tables"], strict=True):
            one = ET.SubElement(node, "NamedMap")
            ET.SubElement(one, "MapName").text = name
            if axis["kind"] == "label":
                labels = ET.SubElement(one, "LabelTable")
                for key, label in table.items():
                    ET.SubElement(labels, "Label", Key=str(key), Red="0", Green="0", Blue="0", Alpha="1").text = label
    return node


def _volume_xml(node: ET.Element, axis: dict) -> None:
    """The voxel space of an axis: shape and affine, if it has one."""
    if axis.get("shape") is not None:
        volume = ET.SubElement(node, "Volume", VolumeDimensions=",".join(map(str, axis["shape"])))
        affine = np.asarray(axis.get("affine", np.eye(4)), float)
        ET.SubElement(volume, "TransformationMatrixVoxelIndicesIJKtoXYZ", MeterExponent="-3").text = " ".join(map(str, affine.ravel()))


def write_cifti(matrix: np.ndarray, axes: dict[int, dict]) -> bytes:
    """A CIFTI-2 file of a matrix (rows, columns) and the descriptions of its axes."""
    matrix = np.asarray(matrix)
    root = ET.Element("CIFTI", Version="2")
    inner = ET.SubElement(root, "Matrix")
    if axes[0] == axes[1]:
        inner.append(_axis_xml(axes[0], "0,1"))
    else:
        inner.append(_axis_xml(axes[1], "0"))
        inner.append(_axis_xml(axes[0], "1"))
    xml = ET.tostring(root)
    size = -(-(len(xml) + 8) // 16) * 16
    extension = b"\1\0\0\0" + struct.pack("<2i", size, 32) + xml.ljust(size - 8, b"\0")
    values = matrix.T.astype("<f4" if matrix.dtype.kind == "f" and matrix.dtype.itemsize == 4 else "<f8" if matrix.dtype.kind == "f" else "<i4")
    head = bytearray(540)
    struct.pack_into("<i", head, 0, 540)
    head[4:12] = b"n+2\0\r\n\x1a\n"
    code = next(c for c, t in NIFTI_TYPES.items() if np.dtype(t) == values.dtype.newbyteorder("="))
    struct.pack_into("<2h", head, 12, code, values.dtype.itemsize * 8)
    struct.pack_into("<8q", head, 16, 6, 1, 1, 1, 1, *values.shape, 1)
    struct.pack_into("<8d", head, 104, *[1.0] * 8)
    struct.pack_into("<q", head, 168, 540 + len(extension))
    struct.pack_into("<2d", head, 176, 1.0, 0.0)
    return bytes(head) + extension + values.tobytes(order="F")


def read_freesurfer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a binary FreeSurfer surface."""
    if data[:3] != b"\xff\xff\xfe":
        raise ValueError("not a FreeSurfer triangle file")
    at = data.index(b"\n\n") + 2
    n, m = struct.unpack_from(">2i", data, at)
    points = np.frombuffer(data, ">f4", 3 * n, at + 8).reshape(n, 3)
    return points.astype(float), np.frombuffer(data, ">i4", 3 * m, at + 8 + 12 * n).reshape(m, 3).astype("i4")


def write_freesurfer(points: np.ndarray, triangles: np.ndarray, comment: str = "created by a program") -> bytes:
    head = b"\xff\xff\xfe" + comment.encode() + b"\n\n" + struct.pack(">2i", len(points), len(triangles))
    return head + np.asarray(points, ">f4").tobytes() + np.asarray(triangles, ">i4").tobytes()
