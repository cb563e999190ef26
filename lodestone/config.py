"""Constants of the engine."""

from __future__ import annotations

CHUNK_TOKENS = 400
CHUNK_OVERLAP = 60
BM25_K1 = 1.5
BM25_B = 0.75
ALPHA = 0.5
LIMIT = 10
SEMANTIC_FLOOR = 0.36
FUSED_FLOOR = 0.005
POOL = 500
EMBED_DIM = 384
EMBED_BATCH = 64
MAX_FILE_BYTES = 50 * 1024 * 1024
RECENT = ((7 * 86400, 0.08), (30 * 86400, 0.04))
FILTER_ONLY_SCORE = 0.70
PER_DOCUMENT = 2
SNIPPET_CHARS = 350
SNIPPET_LEAD = 100

# File suffixes that the engine knows, by family.
SUPPORTED_EXTENSIONS = frozenset(
    """.pdf .docx .doc .pptx .ppt .xlsx .xls .odt .odp .ods .rtf .tex
    .txt .md .markdown .html .htm .rst
    .py .sh .bash .zsh .fish .c .cpp .cc .cxx .h .hpp .js .jsx .ts .tsx .rs .go .java .kt .sql .ipynb
    .json .yaml .yml .toml .ini .cfg .conf .xml .csv .tsv .log
    .png .jpg .jpeg .webp .gif .svg .bmp .tiff
    .mp4 .mkv .avi .mov .webm .flv .wmv .m4v
    .mp3 .wav .flac .ogg .m4a .aac .opus .wma
    .srt .vtt .sub .ass
    .zip .tar .gz .tgz .bz2 .xz .7z .rar
    .epub .mobi .fb2""".split()
)

# Folders and file names that are never read.
IGNORED_DIRS = frozenset(".git .svn .hg .ssh .gnupg .aws .docker .venv venv env node_modules __pycache__ .cache .config .local site-packages dist build .idea .vscode".split())
SENSITIVE_NAMES = (".env", "id_rsa", "id_ed25519", "id_dsa", "known_hosts", "credentials", ".pem", ".key", ".pfx", ".p12", "authorized_keys", ".bash_history", ".zsh_history")
SCRATCH_SUFFIXES = (".db-wal", ".db-shm", ".db-journal", ".lock", ".tmp", ".swp")

# Suffixes of each kind in the query syntax.
TYPE_EXTENSIONS = {
    "code": frozenset(".py .js .ts .jsx .tsx .java .c .cpp .h .hpp .cs .go .rs .rb .php .swift .kt .scala .sh .bash .sql .html .css .scss .json .yaml .yml .xml .toml .ini .env .lua .r .dart .proto .ipynb".split()),
    "doc": frozenset(".pdf .docx .doc .txt .md .markdown .rst .rtf .epub .odt .pptx .xlsx .csv .tsv".split()),
    "image": frozenset(".png .jpg .jpeg .webp .gif .svg .bmp .tiff .ico".split()),
}
TYPE_ALIASES = {
    "code": ("code", "source", "dev", "kod"),
    "doc": ("doc", "document", "belge", "text"),
    "image": ("image", "img", "resim", "gorsel", "görsel"),
}

# English and Turkish stop words.
STOP_WORDS = tuple(
    """a about above after again against all am an and
    any are aren't as at be because been before being
    below between both but by can't cannot could couldn't
    did didn't do does doesn't doing don't down during
    each few for from further had hadn't has hasn't
    have haven't having he he'd he'll he's her here
    here's hers herself him himself his how how's i
    i'd i'll i'm i've if in into is isn't it it's
    its itself let's me more most mustn't my myself
    no nor not of off on once only or other ought
    our ours ourselves out over own same shan't she
    she'd she'll she's should shouldn't so some such
    than that that's the their theirs them themselves
    then there there's these they they'd they'll they're
    they've this those through to too under until up
    very was wasn't we we'd we'll we're we've were
    weren't what what's when when's where where's which
    while who who's whom why why's with won't would
    wouldn't you you'd you'll you're you've your yours
    ve ile de da bu şu o bir gibi için olan
    kadar daha çok ama fakat ancak lakin çünkü
    veya ya ise hiç bazı tüm hep nasıl neden
    ne nerede kim hangi mi mı mu mü bunu şunu onu""".split()
)
