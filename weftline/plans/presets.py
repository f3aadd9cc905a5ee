"""Named settings of the sequence operators, one per kind of model input."""

from __future__ import annotations

from dataclasses import dataclass

IMAGE_SLOTS = 64


@dataclass(frozen=True)
class Preset:
    """How one kind of sample is encoded.

    ``media`` gives the markers, ``prefix`` the ones in front of the mask, ``cut`` the
    place of the feature slots, ``slots`` what stands there.
    """

    max_len: int
    media: tuple[str, ...]
    prefix: int
    cut: int
    slots: tuple[tuple[str, int], ...]
    optional: bool = False


_IMAGE = (("image", IMAGE_SLOTS),)
_AUDIO = (("image", IMAGE_SLOTS), ("audio", 1))
_VIDEO = (("image", IMAGE_SLOTS), ("audio", 1), ("video", 1))
_ANY = (*_VIDEO, ("any", 1))

# Length caps, markers, mask prefix and cut of each preset.
PRESETS = {
    "image": Preset(8192, ("image",), 64, 2, _IMAGE),
    "image_t5": Preset(1984, ("image",), 64, 2, _IMAGE),
    "image_bpe": Preset(1984, ("image",), 64, 2, _IMAGE),
    "audio": Preset(1984, ("image", "audio"), 64, 3, _AUDIO),
    "audio_d2v": Preset(1984, ("image", "audio"), 64, 3, _AUDIO),
    "audio_optional": Preset(1984, ("image", "audio"), 0, 3, _AUDIO, optional=True),
    "video": Preset(1984, ("image", "audio", "video"), 64, 6, _VIDEO),
    "video_optional": Preset(1984, ("image", "audio", "video"), 0, 6, _VIDEO, optional=True),
    "video_bind": Preset(1984, ("image", "audio", "video"), 64, 6, _VIDEO),
    "any": Preset(1984, ("image", "audio", "video", "any"), 64, 6, _ANY),
    "any_liked": Preset(1984, ("image", "audio", "video", "any"), 64, 6, _ANY),
    "any_cached": Preset(1984, ("image", "audio", "video", "any"), 64, 6, _ANY),
}
