"""Small files built in memory."""

import zlib

import numpy as np

from quirelake.functions import jpeg
from quirelake.functions.pdf import Document, Name, Ref, Stream, write_classic, write_packed

FONT = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}


def build(contents, *, fonts=None, xobjects=None, page=None, catalog=None, extra=None, media=(0, 0, 612, 792), shared=False, packed=False, trailer=None):
    """contents: bytes of each page. extra: number -> object."""
    objects = {Ref(1, 0): {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | (catalog or {})}
    n, kids = 10, []
    for i, body in enumerate(contents):
        own = Ref(n, 0)
        stream = Ref(11, 0) if shared else Ref(n + 1, 0)
        objects[stream] = Stream({}, body)
        resources = {"Font": fonts or {"F1": Ref(3, 0)}} | ({"XObject": xobjects} if xobjects else {})
        objects[own] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": stream, "Resources": resources} | (page or {}) if i == 0 or not page else {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": stream, "Resources": resources}
        kids.append(own)
        n += 2
    objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": list(media)}
    objects[Ref(3, 0)] = dict(FONT)
    objects |= {Ref(k, 0): v for k, v in (extra or {}).items()}
    doc = Document(objects, {"Root": Ref(1, 0)} | (trailer or {}), "1.7")
    return write_packed(doc) if packed else write_classic(doc)


def picture(side=120, seed=0, colours=3):
    y, x = np.mgrid[0:side, 0:side]
    rng = np.random.default_rng(seed)
    planes = [np.clip(128 + 90 * np.sin((x + seed) / (9 + k)) * np.cos(y / 7) + rng.normal(0, 6, (side, side)), 0, 255) for k in range(colours)]
    return (np.stack(planes, -1) if colours > 1 else planes[0]).astype(np.uint8)


def jpeg_image(side=120, seed=0, quality=95, **more):
    values = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": side, "Height": side, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "Filter": Name("DCTDecode")}
    return Stream(values | more, jpeg.encode(picture(side, seed), quality))


def flate_image(img, **more):
    h, w = img.shape[:2]
    values = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB" if img.ndim == 3 else "DeviceGray"), "Filter": Name("FlateDecode")}
    return Stream(values | more, zlib.compress(img.tobytes(), 1))


def table(spark, *datas):
    return spark.createDataFrame([(i, f"{i}.pdf", len(d), bytearray(d)) for i, d in enumerate(datas)], "doc_id long, path string, length long, content binary")
