"""Files that are described by their name, place and tags: images, audio, video, anything else."""

from __future__ import annotations

import io
import mimetypes
import re
import xml.etree.ElementTree as ET
from datetime import UTC, datetime
from pathlib import PurePosixPath

from lodestone.functions.text import camel_parts

from . import texts
from .base import Chunk, File, decoded, recognised

IMAGES = frozenset(".png .jpg .jpeg .webp .gif .bmp .tiff .svg".split())
AUDIO = frozenset(".mp3 .wav .flac .ogg .m4a .aac .opus .wma".split())
VIDEO = frozenset(".mp4 .mkv .avi .mov .webm .flv .wmv .m4v".split())

# Names of formats that no reader knows.
FORMATS = {
    ".blend": "Blender 3D Projesi / Modeli", ".psd": "Adobe Photoshop Belgesi", ".ai": "Adobe Illustrator Vektör Dosyası", ".sketch": "Sketch Tasarım Dosyası",
    ".fig": "Figma Tasarım Dosyası", ".iso": "CD/DVD Disk İmajı Dosyası", ".torrent": "BitTorrent İndirme Meta Dosyası", ".apk": "Android Uygulama Paketi (APK)",
    ".deb": "Debian / Ubuntu Kurulum Paketi", ".rpm": "RedHat / Fedora Kurulum Paketi", ".cad": "CAD Çizim ve Tasarım Dosyası",
    ".dwg": "AutoCAD Teknik Çizim Dosyası", ".dxf": "AutoCAD Değişim Formatı", ".stl": "3D Yazıcı / Mesh Model Dosyası", ".obj": "3D Wavefront Nesne Modeli",
    ".fbx": "Autodesk 3D Animasyon Modeli", ".gltf": "GLTF 3D Vektör Sahnesi", ".glb": "GLB İkili 3D Model", ".unitypackage": "Unity Oyun Motoru Paketi",
    ".unreal": "Unreal Engine Proje Varlığı", ".exe": "Windows Çalıştırılabilir Program", ".msi": "Windows Kurulum Paketi", ".dmg": "macOS Disk İmajı",
    ".pkg": "macOS / BSD Kurulum Paketi", ".sqlite": "SQLite Veritabanı Dosyası", ".db": "Veritabanı Dosyası", ".bak": "Sistem / Veri Yedek Dosyası",
    ".dump": "Veritabanı Dökümü", ".cert": "Güvenlik Sertifikası", ".crt": "SSL / TLS Sertifika Dosyası",
}


def _folders(path: PurePosixPath, last: int) -> list[str]:
    return [p for p in path.parent.parts[-last:] if not p.startswith(".")]


def path_tags(path: PurePosixPath) -> str:
    words = dict.fromkeys(re.split(r"[_.\s\-]+", path.stem) + _folders(path, 3))
    return ", ".join(w for w in words if len(w) > 1 and not w.isdigit())


def clock(seconds: float) -> str:
    return f"{int(seconds // 60)}:{int(seconds % 60):02d}"


def _described(lines: list[str], title: str) -> Chunk:
    return Chunk("\n".join(lines), section_title=title, start_line=1, end_line=len(lines))


def _svg(f: File) -> Chunk:
    found = []
    try:
        for e in ET.fromstring(f.content).iter():
            if str(e.tag).rsplit("}", 1)[-1].lower() in ("text", "tspan", "title", "desc") and (e.text or "").strip():
                found.append(e.text.strip())
    except ET.ParseError:
        pass
    name = re.sub(r"[_.-]+", " ", f.path.stem)
    parts = [f"SVG Vektör Görseli: {f.path.name}", *([f"İsim Etiketleri: {name}"] if name else []), *(["İçerik Metinleri:\n" + "\n".join(found)] if found else [])]
    return Chunk("\n\n".join(parts), section_title=f.path.name, start_line=1, end_line=len(found) + 2)


def _picture(content: bytes, suffix: str) -> list[str]:
    """Size and camera, where an image library is installed."""
    try:
        from PIL import ExifTags, Image
    except ImportError:
        return []
    try:
        with Image.open(io.BytesIO(content)) as img:
            out = [f"Çözünürlük: {img.size[0]}x{img.size[1]} ({img.format or suffix.upper().lstrip('.')}, {img.mode})"]
            exif = {ExifTags.TAGS.get(k, str(k)): str(v).strip() for k, v in img.getexif().items() if isinstance(v, str | int | float) and str(v).strip()}
    except OSError:
        return []
    if "Make" in exif or "Model" in exif:
        out.append(f"Cihaz: {exif.get('Make', '')} {exif.get('Model', '')}".strip())
    if when := exif.get("DateTimeOriginal") or exif.get("DateTime"):
        out.append(f"Çekim Tarihi: {when}")
    labels = {"ImageDescription": "Açıklama", "Software": "Yazılım", "Artist": "Sanatçı"}
    return out + [f"{label}: {exif[k]}" for k, label in labels.items() if k in exif]


# Least and most characters of the text in a picture.
SAID_LEAST, SAID_MOST = 10, 3000


# Fixed values, here and below: the labels that descriptions are made of.
def image(f: File) -> list[Chunk]:
    if f.path.suffix.lower() == ".svg":
        return [_svg(f)]
    tags = path_tags(f.path)
    out = _described([f"Görsel Dosyası: {f.path.name}", *([f"Etiketler ve Konum: {tags}"] if tags else []), *_picture(f.content, f.path.suffix)], f.path.name)
    said = recognised(f.ocr, f.content) if f.ocr else ""
    if len(said) >= SAID_LEAST:
        out.text += f"\n\nGörsel İçi Okunan Metin (OCR):\n{said[:SAID_MOST]}"
        out.end_line += said[:SAID_MOST].count("\n") + 2
    return [out]


# Tags of the audio formats and what they say.
_TAGS = {"TIT2": "Title", "title": "Title", "\xa9nam": "Title", "TPE1": "Artist", "artist": "Artist", "\xa9ART": "Artist", "TALB": "Album", "album": "Album", "\xa9alb": "Album", "TCON": "Genre", "genre": "Genre", "\xa9gen": "Genre", "TDRC": "Year", "date": "Year", "\xa9day": "Year"}
_LABELS = {"Title": "Parça Adı", "Artist": "Sanatçı", "Album": "Albüm", "Genre": "Müzik Türü", "Year": "Yıl"}


def _tagged(content: bytes) -> tuple[dict[str, str], str | None]:
    """Tags and duration, where a tag library is installed."""
    try:
        import mutagen
    except ImportError:
        return {}, None
    try:
        a = mutagen.File(io.BytesIO(content))
    except mutagen.MutagenError:
        return {}, None
    tags = getattr(a, "tags", None) or {}
    say = lambda v: (", ".join(map(str, v)) if isinstance(v, list) else str(v)).strip()
    length = getattr(getattr(a, "info", None), "length", None)
    return {label: say(tags[k]) for k, label in _TAGS.items() if k in tags}, None if length is None else clock(length)


def audio(f: File) -> list[Chunk]:
    tags, length = _tagged(f.content)
    where = path_tags(f.path)
    lines = [f"Ses Dosyası: {f.path.name}", *(f"{label}: {tags[k]}" for k, label in _LABELS.items() if k in tags)]
    lines += [f"Süre: {length}"] if length else []
    lines += [f"Konum ve Etiketler: {where}"] if where else []
    return [_described(lines, tags.get("Title") or f.path.name)]


def video(f: File) -> list[Chunk]:
    length, where = _tagged(f.content)[1], path_tags(f.path)
    lines = [f"Video Dosyası: {f.path.name}", *([f"Süre: {length}"] if length else []), *([f"Video Etiketleri ve Konum: {where}"] if where else [])]
    out = [_described(lines, f.path.name)]
    for name, content in sorted(f.companions):
        said = texts.subtitles(File(f.path.parent / name, content, len(content), f.mtime))
        for c in said:
            c.section_title = f"{f.path.name} (Altyazı: {name})"
        out += said
    return out


def size_words(n: int) -> str:
    for unit, places, name in ((1024**3, 2, "GB"), (1024**2, 1, "MB"), (1024, 1, "KB")):
        if n >= unit:
            return f"{n / unit:.{places}f} {name}"
    return f"{n} Bayt"


def _sample(content: bytes) -> str:
    """The first words of what is text for the most part."""
    head = decoded(content[:8192], errors="ignore")[:2048].strip()
    readable = sum(c.isprintable() or c.isspace() for c in head) / max(1, len(head))
    return re.sub(r"\s+", " ", head)[:500] if readable > 0.90 and len(head) > 10 else ""


def anything(f: File) -> list[Chunk]:
    """A description: name, kind, place, size, age, words of the path and a sample."""
    suffix = f.path.suffix.lower()
    mime = mimetypes.guess_type(f.path.name)[0]
    kind = FORMATS.get(suffix) or (f"{mime} ({suffix})" if mime else f"{suffix.upper().lstrip('.')} Dosyası" if suffix else "Bilinmeyen Dosya")
    folders = _folders(f.path, 4)
    words = camel_parts(f.path.stem)
    keys = dict.fromkeys(w.lower() for w in words + folders if len(w) > 1 and not w.isdigit())
    when = datetime.fromtimestamp(f.mtime, UTC).strftime("%Y-%m-%d %H:%M:%S")
    sample = _sample(f.content) if f.size <= 1024 * 1024 else ""
    lines = [f"Dosya Adı: {f.path.name}", f"Dosya Türü: {kind}", f"Klasör Konumu: {' > '.join(folders) or 'Kök Dizin'}", f"Boyut: {size_words(f.size)} | Son Değiştirilme: {when}"]
    lines += [f"Anlamsal Etiketler: {', '.join(keys)}"] if keys else []
    lines += [f"İçerik Özeti: {sample}"] if sample else []
    return [_described(lines, f.path.name)]
