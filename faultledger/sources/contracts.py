"""What each source system calls its columns.

A ``Contract`` is data: the headers to look for, the defaults for headers that
are absent, and the label of the source. ``operators.mapping`` turns any
contract into one projection.
"""

from dataclasses import dataclass

from faultledger.fixed_values import UNKNOWN
from faultledger.functions.dates import DATE_FORMATS


@dataclass(frozen=True)
class Field:
    """The first of ``headers`` that the extract has, else the constant ``default``.

    The default never replaces an empty cell of a header that is present.
    """

    headers: tuple[str, ...] = ()
    default: str | None = None


@dataclass(frozen=True)
class Contract:
    key: str
    label: str
    plant: Field
    customer: Field
    date: Field
    # One level, or two levels shown as "general - specific".
    defect: tuple[Field, ...]
    credit: Field
    quantity: Field
    # Rows without this id are page headers and footers of the export.
    row_id: str | None = None
    # Drop rows without a date while mapping, not only while cleaning.
    requires_date: bool = False
    # Headers that state the position of a row; by default it is where the row stands in the file.
    row_order: tuple[str, ...] = ()
    date_formats: tuple[str, ...] = DATE_FORMATS
    tag: str | None = None

    def headers(self) -> tuple[str, ...]:
        fields = (self.plant, self.customer, self.date, *self.defect, self.credit, self.quantity)
        found = [h for f in fields for h in f.headers] + list(self.row_order)
        return tuple(dict.fromkeys(([self.row_id] if self.row_id else []) + found))


# Source labels, header texts and default plants of the five sources.
RADIUS = Contract(
    key="Radius",
    label="Radius (L-MCC)",
    plant=Field(("Plant Name",), UNKNOWN),
    customer=Field(("Customer",), UNKNOWN),
    date=Field(("ReportDate",)),
    defect=(Field(("Reason for Rejection",), UNKNOWN),),
    credit=Field(("Value",)),
    quantity=Field(("Quantity",)),
    row_id="Report#",
    requires_date=True,
)
FUSION = Contract(
    key="Fusion",
    label="Fusion (Rochester)",
    plant=Field(default="Rochester"),
    customer=Field(("Customer",), UNKNOWN),
    date=Field(("Create Date",)),
    defect=(Field(("Defect Type Sub Cat",), UNKNOWN),),
    credit=Field(("Total Credit Requested",)),
    quantity=Field(("Total Labels Rejected",)),
)
VISION_NAMES = {
    "OAK": ("Vision (Oak Creek)", "OAK CREEK PLANT"),
    "MAS": ("Vision (Mason)", "MASON PLANT"),
}
OBI = Contract(
    key="OBI",
    label="OBI (L-FDC)",
    plant=Field(("Plant Name",), UNKNOWN),
    customer=Field(("Customer",), UNKNOWN),
    date=Field(("Received Date", "Received Dt")),
    defect=(Field(("General Category",), ""), Field(("Specific Category",), "")),
    credit=Field(("Feedback Total Credit Requested",)),
    quantity=Field(("Qty in Question",)),
)


def vision(tag: str) -> Contract:
    """The Vision system has one export per site; a site not named above labels itself."""
    tag = tag.upper()
    label, plant = VISION_NAMES.get(tag, (f"Vision ({tag})", tag))
    return Contract(
        key=f"Vision_{tag}",
        label=label,
        plant=Field(("Plant",), plant),
        customer=Field(("Customer Name",), UNKNOWN),
        date=Field(("Report Date",)),
        defect=(Field(("Type",), UNKNOWN), Field(("Sub-Type",), "")),
        credit=Field(("Net Credit $",)),
        quantity=Field(("Defective Qty",)),
        tag=tag,
    )


# In the order in which sources are stacked.
CONTRACTS = {c.key: c for c in (RADIUS, FUSION, vision("OAK"), vision("MAS"), OBI)}
