"""Which files are indexed and in what language."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 2 * 1024 * 1024

# Extensions that are never text.
BINARY = (
    "png jpg jpeg gif bmp ico webp tiff tif svg psd heic mp3 wav flac ogg aac m4a mp4 m4v mov avi mkv webm "
    "zip jar war aar ear tar gz tgz bz2 xz zst 7z rar lz4 so dylib dll a lib o obj class dex exe bin wasm node pyc pyo pdb elf ko "
    "apk aab ipa spv nib car ttf otf woff woff2 eot pdf doc docx xls xlsx ppt pptx sqlite db dat "
    "gguf safetensors onnx pt pth ckpt npy npz parquet"
).split()
# Language buckets and their extensions.
EXTENSIONS = {
    "rust": "rs", "python": "py pyi", "cpp": "cpp cc cxx hpp hxx h ipp", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "go": "go", "csharp": "cs",
    "java": "java", "toml": "toml", "markdown": "md markdown", "dart": "dart", "yaml": "yaml yml", "json": "json", "xml": "xml", "gradle": "gradle kts",
    "properties": "properties", "kotlin": "kt", "swift": "swift", "shell": "sh bash zsh", "systemd": "service socket timer mount target path", "env": "env",
    "text": "txt local example ini cfg conf",
}


def extension(path: Column) -> Column:
    """The part after the last dot of the file name, in its own case, or ''; a leading dot begins a name, not an extension."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)\z", 1)


def language_from_ext(ext: Column) -> Column:
    """The language bucket of an extension (case matters), ``text`` where it is unknown."""
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("text"))


def extensions_for_language(lang: str) -> list[str]:
    """Extensions of a bucket; none for an unknown one."""
    return EXTENSIONS.get(lang, "").split()


def admits(ext: Column, size: Column, languages: list[str] | None = None) -> Column:
    """A whitelist of languages without a size cap, or everything up to 2 MiB that isn't binary."""
    if languages:
        return ext.isin([e for x in languages for e in extensions_for_language(x)])
    return ~F.lower(ext).isin(BINARY) & (size <= MAX_BYTES)


def text_of(content: Column) -> Column:
    """The text of file bytes; null where they hold a NUL byte or are not UTF-8."""
    ok = (F.position(F.unhex(F.lit("00")), content) == 0) & F.is_valid_utf8(content.cast("string"))
    return F.when(ok, F.decode(content, "UTF-8"))


@lru_cache(4096)
def _glob(pattern: str) -> re.Pattern:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i + 1] if c == "\\" and i + 1 < len(pattern) else c), i + (2 if c == "\\" else 1)
    return re.compile(out + r"\Z")


class IgnoreRules:
    """Patterns of ignore files, each with the folder it lies in ('' for the root); later rules win."""

    def __init__(self, files: dict[str, str]) -> None:
        self.rules = []
        for folder in sorted(files, key=lambda f: (f.count("/") if f else -1, f)):
            for line in files[folder].splitlines():
                line = line.rstrip()
                if line and not line.startswith("#"):
                    keep = line.startswith("!")
                    line = line[keep:]
                    only_dir = line.endswith("/")
                    line = line.rstrip("/")
                    anchored = "/" in line
                    self.rules.append((folder, _glob(line.lstrip("/") if anchored else "**/" + line), only_dir, keep))

    def _match(self, path: str, is_dir: bool) -> bool:
        ignored = False
        for folder, pattern, only_dir, keep in self.rules:
            if folder and not path.startswith(folder + "/"):
                continue
            if (is_dir or not only_dir) and pattern.match(path[len(folder) + 1 :] if folder else path):
                ignored = not keep
        return ignored

    def ignores(self, path: str) -> bool:
        """Whether a file is ignored, by itself or with a folder above it."""
        parts = path.split("/")
        return any(self._match("/".join(parts[:n]), n < len(parts)) for n in range(1, len(parts) + 1))
