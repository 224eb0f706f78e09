import pytest

from filetwin import schemas
from filetwin.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", app="filetwin-tests")
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture
def make(spark):
    """Builds catalog tables from short dictionaries."""

    def file(path, **values):
        folder = path.rsplit("/", 1)[0]
        root = "/" + path.split("/")[1]
        row = dict(
            path=path,
            size=10,
            mtime=100,
            hash_value="h",
            hash_algorithm="sha512",
            error_status=None,
            first_scanned_at=1000,
            last_scanned_at=2000,
            removed=0,
            folder_path=folder,
            root_path=root,
        )
        row.update(values)
        return row

    def folder(path, **values):
        parts = path.split("/")
        row = dict(
            folder_path=path,
            parent_path="/".join(parts[:-1]) if len(parts) > 2 else None,
            root_path="/" + parts[1],
            error_status=None,
            first_scanned_at=1000,
            last_scanned_at=2000,
            removed=0,
        )
        row.update(values)
        return row

    def root(path, **values):
        row = dict(
            root_path=path,
            agent_id=1,
            traverse_links=0,
            last_scan_date=None,
            folder_count=0,
            file_count=0,
            total_size=0,
        )
        row.update(values)
        return row

    class Make:
        @staticmethod
        def files(*specs):
            built = [file(s) if isinstance(s, str) else file(s[0], **s[1]) for s in specs]
            return spark.createDataFrame([tuple(r[n] for n in schemas.FILES.names) for r in built], schemas.FILES)

        @staticmethod
        def folders(*specs):
            built = [folder(s) if isinstance(s, str) else folder(s[0], **s[1]) for s in specs]
            return spark.createDataFrame([tuple(r[n] for n in schemas.FOLDERS.names) for r in built], schemas.FOLDERS)

        @staticmethod
        def roots(*specs):
            built = [root(s) if isinstance(s, str) else root(s[0], **s[1]) for s in specs]
            return spark.createDataFrame([tuple(r[n] for n in schemas.ROOTS.names) for r in built], schemas.ROOTS)

    return Make
