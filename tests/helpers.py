from datetime import datetime

BOOKING = (
    "booking_id long, customer_id string, customer_name string, customer_segment string, booking_date timestamp, created_at timestamp,"
    " total_price_idr double, status string, payment_status string, channel string, destination_name string, package_type string,"
    " payment_method string, is_repeat_customer boolean, pax_count int, nights int, campaign_id string, agent_id string")


def ts(text):
    return datetime.fromisoformat(text)


def bookings(spark, rows):
    """Rows as dicts; missing fields get plain values, an explicit None stays null."""
    base = dict(customer_id="c1", customer_name="Ani", customer_segment="Gold", total_price_idr=100.0, status="Completed",
                payment_status="Paid", channel="Web", destination_name="Bali", package_type="City", payment_method="Card",
                is_repeat_customer=False, pax_count=2, nights=3, campaign_id=None, agent_id=None)
    names = [c.split()[0] for c in BOOKING.split(", ")]
    out = []
    for i, r in enumerate(rows):
        full = {"booking_id": i, **base, **r}
        day = full.get("booking_date") or full.get("created_at") or "2024-01-01"
        full["booking_date"] = ts(full.get("booking_date") or day)
        full["created_at"] = ts(full.get("created_at") or day)
        out.append(tuple(full[n] for n in names))
    return spark.createDataFrame(out, BOOKING)


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
