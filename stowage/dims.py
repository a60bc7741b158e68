"""Static dimension tables. Fixed values."""

from __future__ import annotations

HASH_SIZES = {"crc32": 4, "md5": 16, "sha1": 20, "sha256": 32}

SYSTEM_PARTS = ("System Volume Information", "$RECYCLE.BIN", "System32", "Windows", ".Trash", ".DS_Store", ".Spotlight-V100", ".fseventsd", ".TemporaryItems")

IGNORE_DEFAULTS = (
    ".git/", ".svn/", ".hg/", ".bzr/", ".build/", "build/", "dist/", "target/", "*.o", "*.a", "*.so", "*.dylib", "*.dll", "*.exe", "*.swiftmodule", "*.swiftdoc", "*.dSYM/",
    "node_modules/", ".venv/", "venv/", "__pycache__/", "*.pyc", "*.pyo", ".idea/", ".vscode/", "*.swp", "*.swo", "*~", ".DS_Store", "Thumbs.db", "*.zip", "*.tar", "*.tar.gz", "*.tgz", "*.gz",
)

# sectors of 512 bytes -> (tracks, heads, sectors per track)
FLOPPY = {720: (40, 2, 9), 1440: (80, 2, 9), 2400: (80, 2, 15), 2880: (80, 2, 18), 5760: (80, 2, 36)}

IMAGE_TYPES = {"dmg": "application/x-apple-diskimage", "iso": "application/x-iso9660-image", "img": "application/octet-stream", "vhd": "application/x-vhd", "vmdk": "application/x-vmdk", "qcow": "application/x-qcow", "qcow2": "application/x-qcow2"}

SPEED_SCORES = {"very-fast": 100, "fast": 80, "medium": 50, "slow": 20, "very-slow": 10, "unknown": 0}
DEFAULT_PRIORITIES = {"primary": 0, "secondary": 100, "glacier": 200, "mirror": 150}

# by extension, in the order of precedence
TYPE_GROUPS = {
    "image": ("png", "jpg", "jpeg", "gif", "tiff", "tif", "bmp", "heic", "heif", "webp", "pict", "pct", "mac", "sgi", "rgb", "rgba", "bw", "icon", "icns", "img", "ima", "imz"),
    "text": ("txt", "text", "md", "markdown", "rtf", "doc", "docx"),
    "basic": ("bas",),
    "binary": ("bin", "exe", "com", "app", "dmg"),
    "archive": ("zip", "tar", "gz", "bz2", "xz", "7z", "rar", "sit", "sitx"),
    "audio": ("mp3", "wav", "aiff", "aif", "m4a", "flac", "ogg", "au", "snd"),
    "video": ("mp4", "mov", "avi", "mkv", "wmv", "flv", "m4v"),
    "graphics": ("pict", "pct", "mac", "sgi", "rgb", "rgba", "bw"),
}
CATEGORY_GROUPS = {"text": "text", "basic": "basic", "binary": "binary", "assembly": "binary", "graphics": "graphics", "audio": "audio", "video": "video", "archive": "archive", "system": "system", "data": "data", "document": "text"}

CODEC_EXTENSIONS = {"gz": "gzip", "gzip": "gzip", "tgz": "gzip", "zip": "zip", "tar": "tar", "arc": "arc", "ark": "arc", "sit": "stuffit", "sitx": "stuffit"}
MAIN_IMAGE_PRIORITY = {"iso": 1, "dmg": 2, "img": 3, "vhd": 4}
ZIP_METHODS = {0: "stored", 1: "shrunk", 2: "reduced-1", 3: "reduced-2", 4: "reduced-3", 5: "reduced-4", 6: "imploded", 8: "deflated", 9: "deflate64"}
DEVICE_KINDS = {0o060000: "block-device", 0o020000: "character-device", 0o140000: "socket", 0o010000: "fifo"}
# method -> (name, era)
ZIP_NAMES = {
    0: ("Stored", None), 1: ("PKZIP Shrinking", "1.0"), 2: ("PKZIP Reducing (Factor 1)", "1.0"), 3: ("PKZIP Reducing (Factor 2)", "1.0"), 4: ("PKZIP Reducing (Factor 3)", "1.0"),
    5: ("PKZIP Reducing (Factor 4)", "1.0"), 6: ("PKZIP Imploding", "1.0"), 8: ("Deflate", "2.0+"), 9: ("Deflate64", "2.0+"), 12: ("BZIP2", "2.0+"), 14: ("LZMA", "2.0+"), 93: ("Zstandard", "2.0+"), 95: ("XZ", "2.0+"),
}
