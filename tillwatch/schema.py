"""Table contracts and fixed lookup values."""

from pyspark.sql import types as T

TICKET_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("paying_method", T.StringType()),
    T.StructField("theater_name", T.DoubleType()),
    T.StructField("device_number", T.StringType()),
    T.StructField("original_price", T.DoubleType()),
    T.StructField("discount_value", T.DoubleType()),
    T.StructField("final_price", T.DoubleType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("status_id", T.IntegerType()),
    T.StructField("campaign_id", T.LongType()),
    T.StructField("movie_name", T.StringType()),
])
CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("usergender", T.StringType()),
    T.StructField("dob", T.StringType()),
])
CAMPAIGN_SCHEMA = T.StructType([
    T.StructField("campaign_id", T.LongType()),
    T.StructField("campaign_type", T.StringType()),
])
DEVICE_SCHEMA = T.StructType([
    T.StructField("device_number", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("platform", T.StringType()),
])
STATUS_SCHEMA = T.StructType([
    T.StructField("status_id", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("error_group", T.StringType()),
])
TICKETS = "ticket_history"
SCHEMAS = {
    TICKETS: TICKET_SCHEMA,
    "customer": CUSTOMER_SCHEMA,
    "campaign": CAMPAIGN_SCHEMA,
    "device_detail": DEVICE_SCHEMA,
    "status_detail": STATUS_SCHEMA,
}
REFERENCE_KEYS = {
    "customer": "customer_id",
    "campaign": "campaign_id",
    "device_detail": "device_number",
    "status_detail": "status_id",
}
ERROR_GROUPS = ["customer", "external", "internal"]

# --- fixed values: these texts and numbers must equal the original ones for results to match ---

STATUS_ROWS = [
    (1, "Order successful", None),
    (-1, "Payment overdue", "customer"),
    (-2, "Insufficient funds in customer account. Please add more funds and try the transaction again.", "customer"),
    (-3, "No response from your bank", "external"),
    (-4, "Password locked due to multiple incorrect attempts. Choose Forgot Password to unlock.", "customer"),
    (-5, "Payment failed from bank", "external"),
    (-6, "Need verify your account to continue", "customer"),
    (-7, "Transaction temporarily limited", "internal"),
]
PAYING_METHODS = ["money in app", "bank account", "credit card", "debit card", "other"]
GENDERS = ["Male", "Female", "Not verify"]
CAMPAIGN_TYPES = ["direct discount", "voucher", "reward point"]
PLATFORMS = ["mobile", "website"]

SEGMENT_ACTIONS = {
    "Khách giá trị cao": "Membership, ưu đãi đặc quyền, đặt vé sớm phim hot",
    "Khách mua một lần (mới)": "Tặng coupon cho lần mua thứ hai trong vòng 7–14 ngày",
    "Khách lâu chưa quay lại": "Kéo lại bằng phim mới, voucher quay lại, thông báo cá nhân hóa",
    "Khách nhạy khuyến mãi": "Chuyển từ giảm giá trực tiếp sang tích điểm, voucher cá nhân hóa",
    "Khách thường xuyên": "Duy trì, không cần giảm giá sâu",
}
RECOVERY_MESSAGES = {
    -1: "Đơn đặt vé của bạn đã quá hạn thanh toán. Ghế vẫn có thể còn trống - đặt lại trong 1 chạm tại đây.",
    -2: "Tài khoản chưa đủ số dư nên giao dịch chưa thành công. Bạn có thể thanh toán bằng Ví trong app để giữ ghế.",
    -3: "Ngân hàng chưa phản hồi nên vé chưa được xuất. Bạn chưa bị trừ tiền - thử lại hoặc chọn Ví trong app.",
    -4: "Tài khoản thanh toán bị khóa tạm do nhập sai mật khẩu nhiều lần. Chọn 'Quên mật khẩu' để mở khóa rồi đặt lại vé.",
    -5: "Thanh toán qua ngân hàng chưa thành công (lỗi từ phía ngân hàng). Thử lại sau ít phút hoặc chọn Ví trong app.",
    -6: "Bạn cần xác minh tài khoản để tiếp tục thanh toán. Hoàn tất xác minh trong 2 phút tại đây.",
    -7: "Giao dịch đang bị giới hạn tạm thời. Đội hỗ trợ sẽ liên hệ bạn - hoặc nhắn tin cho chúng tôi để được xử lý ngay.",
}
# KPI code -> (group number, format, +1 when a rise is good / -1 when a fall is good)
KPI_DIRECTIONS = {
    "success_tickets": (1, "int", 1),
    "conversion": (1, "pct", 1),
    "revenue": (1, "money", 1),
    "repeat_90d": (2, "pct", 1),
    "retention_30d": (2, "pct", 1),
    "repeat_no_promo_share": (3, "pct", 1),
    "discount_per_retained": (3, "money", -1),
    "payment_success_rate": (4, "pct", 1),
    "payment_failure_rate": (4, "pct", -1),
    "mobile_conversion": (5, "pct", 1),
    "app_completion_rate": (5, "pct", 1),
    "frequency": (6, "float", 1),
    "spend_per_customer": (6, "money", 1),
    "ltv_to_date": (6, "money", 1),
}
# --- end of fixed values ---

#: What the columns of the marts hold.
DESCRIPTIONS = {
    "ticket_id": "Identifier of the payment attempt", "customer_id": "Identifier of the customer", "time": "Time of the payment attempt",
    "date": "Day of the attempt", "week": "Monday of its week", "year_month": "Its month, yyyy-MM", "hour": "Its hour, 0 to 23", "day_name": "Its weekday",
    "paying_method": "Method of payment", "platform": "mobile, website or Unknown", "os_version": "Operating system, from the device model",
    "device_number": "Identifier of the device", "theater_name": "Identifier of the theater", "movie_name": "Title of the movie",
    "campaign_id": "Identifier of the campaign, 0 without one", "campaign_type": "Kind of promotion, none without one",
    "is_promotion": "The attempt used a promotion", "original_price": "Price before the discount", "discount_value": "Amount taken off",
    "final_price": "Price paid: original price less discount", "discount_rate": "Discount as a share of the original price",
    "status_id": "1 for success, otherwise the error code", "status_description": "Text of the status", "error_group": "customer, external, internal or none",
    "is_success": "The payment succeeded", "attempt_number": "Number of the attempt among the customer's, from 1",
    "is_first_attempt": "It is the customer's first attempt", "failure_risk_score": "Model's probability of failure, from what was known before the attempt",
    "usergender": "Gender as given, Not verify where unknown", "dob": "Date of birth", "age": "Age on the last day of the data",
    "age_generation": "Generation by year of birth", "is_verified_profile": "Gender and date of birth were really given",
    "has_activity": "The customer has at least one attempt", "first_attempt_time": "Time of the first attempt", "first_success_time": "Time of the first purchase",
    "n_attempts": "Attempts", "n_success": "Purchases", "n_failed": "Failed attempts", "success_rate": "Purchases as a share of attempts",
    "total_spend": "Sum of prices paid", "total_discount": "Sum of discounts of purchases", "first_attempt_failed": "The first attempt failed",
    "lost_at_first_payment": "The first attempt failed and nothing was ever bought", "as_of": "Time for which the features hold",
    "recency_days": "Days since the last purchase", "tenure_days": "Days since the first purchase", "frequency": "Purchases before that time",
    "n_months": "Months with a purchase", "monetary": "Sum paid before that time", "avg_price": "Mean price of a ticket",
    "promo_share": "Share of purchases with a promotion", "wallet_share": "Share of purchases paid from the wallet",
    "mobile_share": "Share of purchases on mobile", "segment": "Customer segment by fixed rules", "action": "Proposed treatment of the segment",
    "repurchase_score": "Probability of buying again within 90 days, or the recency rule", "score_source": "model, or the rule used instead",
    "tickets": "Attempts", "success_tickets": "Tickets sold", "customers": "Different buyers", "revenue": "Sum of prices paid",
    "discount_spend": "Sum of discounts", "failure_rate": "Failed attempts as a share of all", "new_customers": "Customers whose first purchase it was, 90 days observed",
    "returned_90d": "Share of them that bought again within 90 days", "one_time_rate": "Share of them that did not",
    "discount_per_returned": "Discounts to new customers for each that returned",
}
