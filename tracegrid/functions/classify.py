"""File types and families from first bytes and extensions."""

from pyspark.sql import Column, functions as F

#: First bytes of file types, in the order in which they are tried (offset, bytes in
#: hex, type, family).
SIGNATURES = [
    (0, "4D5A", "PE", "executables"),
    (0, "7F454C46", "ELF", "executables"),
    (0, "25504446", "PDF", "documents"),
    (0, "D0CF11E0A1B11AE1", "OLE2", "documents"),
    (0, "504B0304", "ZIP", "documents"),
    (0, "FFD8FF", "JPEG", "images"),
    (0, "89504E470D0A1A0A", "PNG", "images"),
    (0, "474946383761", "GIF", "images"),
    (0, "474946383961", "GIF", "images"),
    (0, "424D", "BMP", "images"),
    (0, "00000100", "ICO", "images"),
    (0, "49492A00", "TIFF", "images"),
    (0, "4D4D002A", "TIFF", "images"),
    (4, "66747970", "MP4", "media"),
    (0, "1A45DFA3", "MKV", "media"),
    (0, "494433", "MP3", "media"),
    (0, "FFFB", "MP3", "media"),
    (0, "664C6143", "FLAC", "media"),
    (0, "4F676753", "OGG", "media"),
    (0, "526172211A07", "RAR", "archives"),
    (0, "377ABCAF271C", "7Z", "archives"),
    (0, "1F8B", "GZ", "archives"),
    (0, "53514C69746520666F726D61742033", "SQLite", "databases"),
    (4, "EFCDAB89", "ESE", "databases"),
    (0, "72656766", "REG", "system"),
    (0, "456C6646696C6500", "EVTX", "documents"),
    (0, "2142444E", "PST", "documents"),
    (0, "4C000000", "LNK", "documents"),
    (0, "53434341", "PF", "system"),
]
RIFF_FORMS = {"WAVE": ("WAV", "media"), "AVI ": ("AVI", "media"), "WEBP": ("WEBP", "images")}

#: Types and families by extension.
TYPE_OF_EXTENSION = {
    "PE": ("exe", "dll", "sys", "com", "scr"), "ELF": ("elf",), "PDF": ("pdf",), "JPEG": ("jpg", "jpeg"),
    "PNG": ("png",), "GIF": ("gif",), "BMP": ("bmp",), "WEBP": ("webp",), "ICO": ("ico",), "MP4": ("mp4", "mov"),
    "MKV": ("mkv", "webm"), "AVI": ("avi",), "MP3": ("mp3",), "WAV": ("wav",), "FLAC": ("flac",),
    "OGG": ("aac", "ogg"), "ZIP": ("zip",), "RAR": ("rar",), "7Z": ("7z",), "GZ": ("gz",),
    "SQLite": ("sqlite", "sqlite3", "db", "db3"), "EVTX": ("evtx",), "PST": ("pst", "ost"), "LNK": ("lnk",),
    "PF": ("pf",), "E01": ("e01",), "VMDK": ("vmdk",),
    "Office": ("doc", "docx", "xls", "xlsx", "ppt", "pptx"), "ESE": ("mdb", "edb"),
}
FAMILY_OF_TYPE = {
    "executables": ("PE", "ELF"), "documents": ("PDF", "EVTX", "PST", "LNK", "Office"),
    "images": ("JPEG", "PNG", "GIF", "BMP", "WEBP", "ICO"),
    "media": ("MP4", "MKV", "AVI", "WAV", "MP3", "FLAC", "OGG"), "databases": ("SQLite", "ESE"),
    "archives": ("ZIP", "RAR", "7Z", "GZ"), "system": ("PF",), "forensics": ("E01", "VMDK"),
}
OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "docm", "xlsm", "pptm")


def type_of_extension(ext: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, names in TYPE_OF_EXTENSION.items():
        found = F.when(F.lower(ext).isin(*names), kind).otherwise(found)
    return found


def family_of(file_type: Column, ext: Column, name: Column, path: Column) -> Column:
    """Logs and thumbnail stores go by name and path, the rest by type; else ``other``."""
    family = F.lit("other")
    for group, kinds in FAMILY_OF_TYPE.items():
        family = F.when(file_type.isin(*kinds), group).otherwise(family)
    is_log = F.lower(path).contains("winevt/logs/") | (F.lower(ext) == "log") | F.lower(name).isin("wtmp", "btmp", "utmp")
    thumbs = F.lower(name).startswith("thumbcache_") | (F.lower(name) == "thumbs.db")
    return F.when(is_log, "documents").when(thumbs, "images").otherwise(family)


def magic(header: Column, ext: Column) -> Column:
    """A struct ``file_type, family`` from the first bytes; null if no signature fits. RIFF files
    go by their form; ZIP files are archives unless their extension is one of office files."""
    digits = F.hex(F.substring(header, 1, 32))
    pair = lambda a, b: F.struct(F.lit(a).alias("file_type"), F.lit(b).alias("family"))
    nothing = F.lit(None).cast("struct<file_type:string,family:string>")
    found = nothing
    for offset, signature, kind, family in reversed(SIGNATURES):
        fits = F.substring(digits, 2 * offset + 1, len(signature)) == signature
        value = pair(kind, family)
        if kind == "ZIP":
            value = F.when(F.lower(ext).isin(*OFFICE), pair("ZIP", "documents")).otherwise(pair("ZIP", "archives"))
        found = F.when(fits, value).otherwise(found)
    riff = nothing
    for form, (kind, family) in RIFF_FORMS.items():
        riff = F.when(F.substring(digits, 17, 8) == form.encode().hex().upper(), pair(kind, family)).otherwise(riff)
    is_riff = digits.startswith(b"RIFF".hex().upper()) & (F.length(header) >= 12)
    return F.when(is_riff, riff).otherwise(found)
