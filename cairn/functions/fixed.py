"""Lists that must equal those of the tag, text and scan rules for the same results."""

# Extensions whose files are text.
TEXT_EXTS = (
    "txt text md markdown mdx rst adoc asciidoc org tex bib srt vtt po pot man "
    "csv tsv log ndjson jsonl "
    "ini cfg conf config properties env editorconfig json json5 jsonc yaml yml toml xml xsd xsl xslt plist resx svg "
    "html htm xhtml css scss sass less vue svelte astro "
    "js mjs cjs jsx ts mts cts tsx "
    "rs py pyi pyx go java kt kts scala groovy c h cc cpp cxx hpp hh hxx cs fs fsx vb rb erb rake php pl pm "
    "lua r jl swift dart ex exs erl hrl hs ml mli nim zig clj cljs elm coffee "
    "sh bash zsh fish ps1 psm1 psd1 bat cmd mk cmake gradle sbt bazel bzl "
    "sql graphql gql proto thrift avsc tf tfvars hcl "
    "ipynb patch diff"
).split()
# Extensions whose files have no text body.
BINARY_EXTS = (
    "pdf doc docx docm xls xlsx xlsm ppt pptx pptm odt ods odp rtf epub mobi one "
    "exe dll so dylib a lib o obj bin class jar war pyc pyo pdb wasm msi sys ko "
    "zip gz bz2 xz zst lz4 7z rar tar tgz cab whl crate "
    "jpg jpeg png gif bmp ico webp tiff tif heic heif avif psd xcf raw cr2 nef "
    "mp3 wav flac ogg oga m4a aac wma mp4 m4v avi mkv mov wmv webm flv mpg mpeg "
    "ttf otf ttc woff woff2 eot "
    "db db-wal db-shm sqlite sqlite3 mdb accdb iso dmg img vhd vmdk"
).split()
# Extensions whose bodies, and whose own metadata, a parser extracts.
BODY_EXTS = "docx docm xlsx xlsm pptx pptm pdf".split()
META_EXTS = BODY_EXTS + "jpg jpeg tif tiff heic heif avif png webp".split()

# Directory names left out by default (.cargo only where registry is below it), and pseudo-filesystems.
EXCLUDED_NAMES = "node_modules target __pycache__ .git .hg .svn .venv venv .cache .npm .cargo".split()
EXCLUDED_PREFIXES = "/proc /sys /dev /run".split()

# Aliases of extensions.
EXT_ALIASES = {
    "jpeg": "jpg", "jpe": "jpg", "htm": "html", "yml": "yaml", "tif": "tiff", "mpeg": "mpg",
    "markdown": "md", "mdown": "md", "text": "txt", "tgz": "tar.gz",
}

# Leading bytes of formats; the first that fits counts.
SIGNATURES = [
    (b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF87a", "gif"),
    (b"GIF89a", "gif"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"PK\x03\x04", "zip"),
    (b"PK\x05\x06", "zip"), (b"PK\x07\x08", "zip"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"),
    (b"(\xb5/\xfd", "zstd"), (b"7z\xbc\xaf'\x1c", "sevenzip"), (b"Rar!\x1a\x07", "rar"), (b"\x7fELF", "elf"),
    (b"MZ", "pe"), (b"\xfe\xed\xfa\xce", "macho"), (b"\xfe\xed\xfa\xcf", "macho"), (b"\xca\xfe\xba\xbe", "class"),
    (b"SQLite format 3\x00", "sqlite"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole2"), (b"{\x5crtf", "rtf"),
    (b"OggS", "ogg"), (b"fLaC", "flac"), (b"ID3", "mp3"), (b"\x1aE\xdf\xa3", "matroska"), (b"%!PS", "postscript"),
    (b"\x00asm", "wasm"), (b"wOFF", "woff"), (b"wOF2", "woff2"), (b"\x00\x01\x00\x00\x00", "ttf"), (b"OTTO", "otf"),
    (b"8BPS", "psd"), (b"%!", "postscript"),
]

# Format that an extension implies; further extensions of TEXT_EXTS imply text.
EXT_FORMATS = {
    "pdf": "pdf", "png": "png", "jpg": "jpg", "gif": "gif", "webp": "webp", "bmp": "bmp", "tiff": "tiff",
    "ico": "ico", "heic": "heif", "heif": "heif", "psd": "psd", "svg": "xml", "docx": "ooxml", "xlsx": "ooxml",
    "pptx": "ooxml", "docm": "ooxml", "xlsm": "ooxml", "pptm": "ooxml", "doc": "ole2", "xls": "ole2",
    "ppt": "ole2", "msi": "ole2", "msg": "ole2", "odt": "opendocument", "ods": "opendocument",
    "odp": "opendocument", "rtf": "rtf", "epub": "zip", "zip": "zip", "jar": "zip", "war": "zip", "whl": "zip",
    "apk": "zip", "gz": "gzip", "tar.gz": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd", "7z": "sevenzip",
    "rar": "rar", "tar": "tar", "exe": "pe", "dll": "pe", "sys": "pe", "so": "elf", "dylib": "macho",
    "class": "class", "wasm": "wasm", "sqlite": "sqlite", "sqlite3": "sqlite", "db": "sqlite", "mp3": "mp3",
    "flac": "flac", "ogg": "ogg", "oga": "ogg", "wav": "wav", "mp4": "mp4", "m4v": "mp4", "m4a": "mp4",
    "mkv": "matroska", "webm": "matroska", "avi": "avi", "ttf": "ttf", "otf": "otf", "woff": "woff",
    "woff2": "woff2", "ps": "postscript", "eps": "postscript", "xml": "xml", "xsd": "xml", "xsl": "xml",
    "xslt": "xml", "plist": "xml", "resx": "xml",
}
# Formats that the content of an extension may have; others are a mismatch.
EXPECTED_FORMATS = {
    "pdf": "pdf", "png": "png", "jpg": "jpg", "gif": "gif", "bmp": "bmp", "tiff": "tiff", "webp": "webp riff",
    "psd": "psd", "heic": "heif mp4", "heif": "heif mp4", "docx": "zip ooxml", "xlsx": "zip ooxml",
    "pptx": "zip ooxml", "docm": "zip ooxml", "xlsm": "zip ooxml", "pptm": "zip ooxml",
    "odt": "zip opendocument", "ods": "zip opendocument", "odp": "zip opendocument", "doc": "ole2",
    "xls": "ole2", "ppt": "ole2", "msi": "ole2", "zip": "zip", "jar": "zip", "war": "zip", "whl": "zip",
    "apk": "zip", "epub": "zip", "gz": "gzip", "tar.gz": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd",
    "7z": "sevenzip", "rar": "rar", "exe": "pe", "dll": "pe", "so": "elf", "class": "class", "wasm": "wasm",
    "sqlite": "sqlite", "sqlite3": "sqlite", "mp3": "mp3 binary", "flac": "flac", "ogg": "ogg", "oga": "ogg",
    "wav": "wav riff", "avi": "avi riff", "mp4": "mp4", "m4v": "mp4", "m4a": "mp4", "mkv": "matroska",
    "webm": "matroska", "ttf": "ttf", "otf": "otf", "woff": "woff", "woff2": "woff2",
}
# Kinds by extension; further extensions of TEXT_EXTS are code.
EXT_KINDS = {
    "document": "pdf doc docx docm odt rtf epub mobi pages one djvu xps tex",
    "spreadsheet": "xls xlsx xlsm ods numbers csv tsv",
    "presentation": "ppt pptx pptm odp key",
    "image": "jpg png gif bmp ico webp tiff heif avif svg psd xcf raw cr2 nef",
    "audio": "mp3 wav flac ogg oga m4a aac wma",
    "video": "mp4 m4v avi mkv mov wmv webm flv mpg",
    "archive": "zip gz tar.gz bz2 xz zst lz4 7z rar tar cab whl crate jar war apk",
    "executable": "exe dll so dylib a lib o obj bin class pyc pyo wasm msi sys ko",
    "font": "ttf otf ttc woff woff2 eot",
    "database": "db sqlite sqlite3 mdb accdb iso dmg img vhd vmdk",
    "config": "ini cfg conf config properties env editorconfig json json5 jsonc yaml toml plist resx tf tfvars hcl",
    "data": "log ndjson jsonl xml xsd xsl xslt avsc parquet",
    "notebook": "ipynb",
    "text": "txt md mdx rst adoc asciidoc org bib srt vtt po pot man patch diff",
}
# Kinds by format, for files whose extension says nothing.
FORMAT_KINDS = {
    "document": "pdf ole2 ooxml opendocument rtf postscript",
    "image": "png jpg gif bmp tiff webp heif psd ico",
    "audio": "mp3 flac ogg wav",
    "video": "mp4 matroska avi",
    "archive": "zip gzip bzip2 xz zstd sevenzip rar tar",
    "executable": "elf pe macho class wasm",
    "font": "ttf otf woff woff2",
    "database": "sqlite",
    "data": "xml",
    "text": "text",
}

# Characters that separate the parts of a name, as a character class; the last is the ideographic space.
NAME_SEPARATORS = r"[-_. +&()\[\]{},;'@!#=~\t　]"
MIN_YEAR, MAX_YEAR = 1970, 2099
VERSION_WORDS = "final draft old latest wip".split()
VERSION_PARTS = {"最終": "final", "最新": "latest", "下書き": "draft"}
COPY_ENDINGS = ["- copy", "のコピー"]
OLD_PREFIX = "旧"
SCREENSHOT_PREFIXES = [
    "screenshot", "screen shot", "screen_shot", "screen-shot", "screencapture", "scr-", "scr_", "snipaste_",
    "スクリーンショット", "画面キャプチャ",
]
CAMERA_PREFIXES = ["img_", "img-", "img", "dsc", "dscf", "dscn", "pxl_", "mvi_", "gopr", "dji_", "vid_", "pano_"]
BACKUP_EXTS = "bak bkp old orig backup save sav".split()
BACKUP_ENDING = "バックアップ"
TEMP_EXTS = "tmp temp swp swo swn part partial crdownload".split()

# Bits of a tag's sources, namespaces that say how a file is and not what it is about, and limits.
SOURCE_BITS = {"ext": 1, "magic": 2, "path": 4, "name": 8, "rule": 16, "embedded": 32}
STRUCTURAL_NAMESPACES = ["format", "ext", "kind", "path"]
MAX_TAGS = 64
MAX_VALUE_CHARS = 128
PATH_COMPONENTS = 12
SNIFF_BYTES = 512
MAX_BODY_BYTES = 2 << 20
