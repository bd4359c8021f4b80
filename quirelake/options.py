"""Options of compression and editing, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Dots per inch and JPEG quality of each profile; custom starts from ebook's.
PROFILES = {"screen": (72, 40), "ebook": (150, 65), "printer": (300, 80), "custom": (150, 65)}
POLICIES = ("flatten", "strict", "ignore")
MIB = 1 << 20


@dataclass(frozen=True)
class CompressOptions:
    profile: str = "ebook"
    image_dpi: int | None = None
    jpeg_quality: int | None = None
    quality_target: float | None = None
    transcode_dpi: int | None = None
    transcode_quality: int | None = None
    max_memory_bytes: int | None = None
    max_parallel_images: int | None = None
    max_image_bytes: int | None = None
    max_pages: int | None = None
    max_objects: int | None = None
    max_total_work_bytes: int | None = None
    max_stream_bytes: int | None = None
    downsample: bool = True
    recompress_streams: bool = True
    remove_metadata: bool = True
    dedupe_images: bool = False
    subset_fonts: bool = False
    grayscale: bool = False
    signatures: str = "flatten"

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile: {self.profile}")
        if self.signatures not in POLICIES:
            raise ValueError(f"unknown signature policy: {self.signatures}")

    def resolved(self) -> tuple[int, int]:
        """(dpi, quality): explicit values win over the profile's."""
        dpi, quality = PROFILES[self.profile]
        return self.image_dpi or dpi, self.jpeg_quality or quality


@dataclass(frozen=True)
class EditOptions:
    """Budgets of one edit."""

    max_input_bytes: int = 256 * MIB
    max_regions: int = 1000
    max_page_bytes: int = 64 * MIB
    max_operators: int = 1_000_000
    max_streams: int = 4096
    max_depth: int = 32
    max_objects: int = 65_536
    max_total_bytes: int = 256 * MIB
    overflow_share: float = 0.10
    scan_pages: int = 8


@dataclass(frozen=True)
class Region:
    """A rectangle on a page (0-based), in points from the lower left."""

    id: str
    page: int
    x: float
    y: float
    width: float
    height: float


@dataclass(frozen=True)
class Replacement(Region):
    text: str = field(default="")
