"""Small tables with known answers."""

import datetime as dt


def students(spark):
    """20 rows: sleep, stress and a gender that is blank in every fourth row."""
    rows = []
    for i in range(20):
        sleep = 3.0 + (i % 6) * 0.7
        stress = 8 if sleep < 4 else 5 if sleep < 6 else 3
        gender = None if i % 4 == 0 else ("Male" if i % 2 else "Female")
        rows.append((i, sleep, stress, 50 + i, "yes" if i % 2 else "no", gender))
    return spark.createDataFrame(
        rows,
        "student_id int, sleep_hours_per_night double, stress_level int, productivity_score int, "
        "part_time_job string, gender string",
    )


def performance(spark):
    """40 rows in three blocks."""
    rows = []
    blocks = (
        (12, 4.5, 6.2, 52, 8, "Low", 9.0, 6),
        (18, 8.2, 7.4, 81, 4, "High", 5.0, 4),
        (10, 6.5, 6.9, 68, 6, "Medium", 7.0, 0),
    )
    for count, sleep, gpa, productivity, stress, category, screen, jobs in blocks:
        for i in range(count):
            job = "true" if i < jobs else "false"
            rows.append((len(rows), sleep, gpa, productivity, stress, job, category, screen))
    return spark.createDataFrame(
        rows,
        "Student_ID int, Sleep_Hours_Per_Night double, Previous_Semester_GPA double, "
        "Productivity_Score int, Stress_Level int, Part_Time_Job string, "
        "Performance_Category string, Screen_Time_Hours double",
    )


def genders(spark):
    values = ["Male", "Female", None, "NaN", "nan", "N/A", "Other", "", "null"]
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "gender string, score int")


def orders(spark):
    rows = [
        (1, "Express", "Yes", 1, 100), (2, "Express", "Yes", 2, 90),
        (3, "Express", "No", 1, 80), (4, "Standard", "Yes", 6, 70),
    ]
    return spark.createDataFrame(
        rows, "Order_ID int, Shipping_Method string, Returned string, Delivery_Days int, Order_Amount int"
    )


def shipping(spark):
    rows = [("Standard", d) for d in (6, 7, 6, 7, 6)] + [("Same-Day", 1)] * 4
    return spark.createDataFrame(rows, "Shipping_Method string, Delivery_Days int")


def jobs(spark):
    rows = [
        (1, 10.5, 1.0, True, "yes", "Pune", "2026-01-01"), (2, 12.0, 2.0, False, "no", "Delhi", "2026-01-02"),
        (3, 9.5, 3.0, True, "yes", "Pune", "2026-01-03"), (4, 15.0, 4.0, None, "no", "Goa", "2026-01-04"),
        (5, 18.0, 5.0, False, "yes", "Delhi", "2026-01-05"), (6, 11.0, 6.0, True, "no", "Goa", "2026-01-06"),
    ]
    return spark.createDataFrame(
        rows,
        "job_id int, salary_lpa double, experience_years double, is_remote boolean, "
        "is_startup string, city string, posted_at string",
    )


def formulas(spark):
    rows = []
    for i in range(80):
        low = 5.0 + (i % 17) * 0.9
        high = low + 4
        price, quantity = 10.0 + (i % 13), 1.0 + (i % 7)
        amount = price * quantity
        rows.append(
            (i, low, high, (low + high) / 2, price, quantity, amount, amount * 0.18,
             i % 12 + 1, (i % 12) // 3 + 1, 2.0 + (i * 7 % 11) * 0.25, ["Data", "Web", "Ops"][i % 3])
        )
    return spark.createDataFrame(
        rows,
        "job_id int, salary_min_lpa double, salary_max_lpa double, salary_midpoint_lpa double, "
        "unit_price double, quantity double, order_amount double, tax_amount double, month int, "
        "quarter int, company_rating double, job_family string",
    )


def vocabulary(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [
        (["A", "B", "C"][i % 3], ["North", "South"][(i // 3) % 2 if i % 5 else 0], 40 + i % 30 + 8 * (i % 3),
         3.0 + (i % 9) * 0.5, 5.0 + (i % 8) * 0.4, start + dt.timedelta(days=i))
        for i in range(120)
    ]
    return spark.createDataFrame(
        rows,
        "segment string, region string, score int, stress double, sleep_hours double, created_at timestamp_ntz",
    )


def ratings(spark):
    rows = []
    for i in range(80):
        salary, experience, remote = 6.0 + (i % 19), 1 + i % 9, i % 2
        rating = round(2.4 + 0.08 * salary + 0.035 * experience + 0.1 * remote, 2)
        rows.append(
            (f"J{i}", f"C{i % 40}", salary, experience, "yes" if remote else "no",
             ["Data", "Web", "Ops"][i % 3], rating)
        )
    return spark.createDataFrame(
        rows,
        "job_id string, company_id string, salary_midpoint_lpa double, experience_years int, "
        "remote_allowed string, job_family string, company_rating double",
    )
