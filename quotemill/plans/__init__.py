from .download import download, download_all

__all__ = ["download", "download_all"]
