"""A search as a Spark data source: one partition per year and file, filters on year and id pushed to the scan (SRC1, SRC2, SRC5).

    spark.dataSource.register(LandedSearch)
    spark.read.format("landed_search").options(path=..., terms="actin bundling|spindle", start=2020, end=2024).load()

Pushing filters needs spark.sql.python.filterPushdown.enabled. The landed table is Parquet with the columns row_id, year, title, abstract. A live service would replace ``hits`` only. Without terms, rows are fetched by id only (a filter on row_id).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition


class YearPartition(InputPartition):
    def __init__(self, year: int, files: list[str]):
        super().__init__((year, tuple(files)))
        self.year, self.files = year, files


def matching(files: list[str], year: int, terms: list[str], ids: list[int] | None, batch: int) -> Iterator:
    """Arrow batches of the rows of a year (and of the given ids) whose title or abstract holds a term, as they are scanned."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    wanted = pc.field("year") == year
    if ids is not None:
        wanted = wanted & pc.field("row_id").isin(ids)
    for b in ds.dataset(files).to_batches(columns=["row_id", "year", "title", "abstract"], filter=wanted, batch_size=batch):
        t = pa.Table.from_batches([b])
        text = pc.utf8_lower(pc.binary_join_element_wise(t["title"].fill_null(""), t["abstract"].fill_null(""), " "))
        mask = None
        for term in terms:
            m = pc.match_substring(text, term.lower())
            mask = m if mask is None else pc.or_(mask, m)
        if ids is not None and not terms:
            yield from t.to_batches()
        elif mask is not None:
            yield from t.filter(mask).to_batches()


def hits(files: list[str], year: int, terms: list[str], limit: int | None, batch: int, ids: list[int] | None = None) -> Iterator:
    """The same; with a limit the first in the order of row_id, of which no more than the limit are held at a time."""
    import pyarrow as pa

    if limit is None:
        yield from matching(files, year, terms, ids, batch)
        return
    held = None
    for b in matching(files, year, terms, ids, batch):
        t = pa.Table.from_batches([b])
        held = (t if held is None else pa.concat_tables([held, t])).sort_by("row_id").slice(0, limit)
    yield from held.to_batches(max_chunksize=batch) if held is not None else []


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.terms = options["path"], [x for x in options.get("terms", "").split("|") if x.strip()]
        self.start, self.end = int(options.get("start", 1900)), int(options.get("end", 2100))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.batch = int(options.get("batch", 1000))
        self.years: list[int] | None = None
        self.ids: list[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("year",):
                self.years = [int(f.value)]
            elif isinstance(f, EqualTo) and f.attribute == ("row_id",):
                self.ids = [int(f.value)]
            elif isinstance(f, In) and f.attribute == ("row_id",):
                self.ids = [int(v) for v in f.value if v is not None]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds

        years = [y for y in (self.years if self.years is not None else range(self.start, self.end + 1)) if self.start <= y <= self.end]
        files = ds.dataset(self.path).files
        # a limit holds for a year as a whole, so its files go to one task, which holds no more rows than the limit
        return [YearPartition(y, part) for y in years for part in ([files] if self.limit is not None else [[f] for f in files])]

    def read(self, partition: InputPartition) -> Iterator:
        yield from hits(partition.files, partition.year, self.terms, self.limit, self.batch, self.ids)


class LandedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_search"

    def schema(self) -> str:
        return "row_id bigint, year int, title string, abstract string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))
